"""Registered queries: decision grid over scenario dates (P1-P8, C17, D5,
D30, B6, H6, P9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decide as P
from ..operators.joins import filter_periods
from ..registry import register
from . import fixtures as FX
from .gold import signal_table
from .silver import daily_features, silver_table
from .sqltext import BARS, GOLD, SILVER, with_ctes

MIN_INSTRUMENTS = 10


def _stocks(spark, sf):
    g = signal_table(silver_table(spark, sf))
    s = filter_periods(g, "dt", FX.scenarios(spark))
    n = F.count(F.lit(1)).over(Window.partitionBy("scenario_id", "dt"))
    return s.withColumn("__n", n).filter(F.col("__n") >= MIN_INSTRUMENTS).drop("__n"), g


def flows(spark, sf):
    s, g = _stocks(spark, sf)
    return P.decision_grid(s, P.make_archetypes(spark), FX.regimes(g), sentiment=FX.daily_sentiment(spark, sf))


def _u(*cols):
    inner = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return "CAST(('0x' || substr(md5(concat_ws('|', " + inner + ")), 1, 8)) AS BIGINT) / 4294967296.0"


def _r3(x):
    return f"(ROUND(({x}) * 1000.0) / 1000.0)"


def _base_values():
    rows = []
    for b in P.BASE_ARCHETYPES:
        rows.append("('" + b[0] + "', " + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in b[1:10]) + f", '{b[10]}')")
    return ",\n    ".join(rows)


def _mods_values():
    return ", ".join(f"('{m[0]}', {m[1]!r}, {m[2]!r}, {m[3]!r}, {m[4]!r})" for m in P.REGIME_MODIFIERS)


def _jit(c, lo=0.0, hi=1.0):
    u = _u("base_type", "variant_index", f"'{c}'")
    return _r3(f"LEAST(GREATEST({c} + ({u} * 0.3 - 0.15) * {c}, {lo}), {hi})")


def _pj(c):
    u = _u("base_type", "variant_index", f"'{c}_p'")
    return f"GREATEST(0.01, {c} + ({u} * 0.1 - 0.05))"


def _or(c, d):
    return f"(CASE WHEN {c} IS NULL OR {c} = 0 THEN {d} ELSE {c} END)"


FLOWS = with_ctes(BARS, SILVER, GOLD).rstrip() + f""",
scen AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', DATE '{a}', DATE '{b}')" for i, n, a, b in FX.SCENARIOS)})
         AS t(scenario_id, scenario_name, start_date, end_date)),{FX.SENTIMENT_SQL},
stk0 AS (SELECT g.*, s.scenario_id FROM gold g JOIN scen s ON g.dt >= s.start_date AND g.dt <= s.end_date),
stk AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY scenario_id, dt) AS nn FROM stk0) WHERE nn >= {MIN_INSTRUMENTS}),
reg AS (SELECT dt AS rdt, {FX.REGIME_SQL}
                              ELSE 'Neutral' END AS rl FROM silver WHERE ticker = 'MKT'),
mods AS (SELECT * FROM (VALUES {_mods_values()}) AS t(regime_label, greed_boost, fear_reduction, buy_bias, urgency_base)),
base AS (SELECT * FROM (VALUES
    {_base_values()}) AS t(base_type, risk, greed, fear, news, contr, buy, call, put, short, sector_pref)),
av AS (SELECT base.*, CAST(v AS INTEGER) AS variant_index FROM base, range(0, {P.VARIANTS}) r(v)),
aj AS (SELECT base_type, variant_index, {_jit('risk')} AS risk_tolerance, {_jit('greed')} AS greed_j,
              {_jit('fear')} AS fear_j, {_jit('news')} AS news_sensitivity, {_jit('contr', -1.0, 1.0)} AS contrarian_factor,
              {_pj('buy')} AS b0, {_pj('call')} AS c0, {_pj('put')} AS p0, {_pj('short')} AS s0, sector_pref FROM av),
arch AS (SELECT base_type || '_v' || lpad(CAST(variant_index AS VARCHAR), 2, '0') AS archetype_id, base_type,
                risk_tolerance, greed_j AS greed, fear_j AS fear, news_sensitivity, contrarian_factor,
                {_r3('b0 / (b0 + c0 + p0 + s0)')} AS buy_prob, {_r3('c0 / (b0 + c0 + p0 + s0)')} AS call_prob,
                {_r3('p0 / (b0 + c0 + p0 + s0)')} AS put_prob, {_r3('s0 / (b0 + c0 + p0 + s0)')} AS short_prob,
                sector_pref AS sector_preference FROM aj),
gr0 AS (SELECT stk.*, sent.sentiment_mean, COALESCE(reg.rl, 'Neutral') AS regime_label FROM stk LEFT JOIN reg ON stk.dt = reg.rdt
        LEFT JOIN sent ON stk.ticker = sent.sticker AND stk.dt = sent.sdt),
gr1 AS (SELECT gr0.*, m.greed_boost, m.fear_reduction, m.buy_bias, m.urgency_base, a.*,
               LEAST(GREATEST(a.greed + m.greed_boost, 0.0), 1.0) AS eff_greed,
               LEAST(GREATEST(a.fear - m.fear_reduction, 0.0), 1.0) AS eff_fear,
               {_or('gr0.daily_return', '0.0')} AS xret, {_or('gr0.drawdown_pct', '0.0')} AS xdd,
               CAST({_or('gr0.signal_score', '0')} AS DOUBLE) AS xgold, {_or('gr0.volume_percentile', '0.5')} AS xvp,
               {_or('gr0.rsi_14', '50.0')} AS xrsi, {_or('gr0.zscore_20d', '0.0')} AS xz,
               {_or('gr0.realized_vol_20d', '0.2')} AS xvol
        FROM gr0 JOIN mods m ON gr0.regime_label = m.regime_label JOIN arch a ON TRUE),
gr2 AS (SELECT gr1.*,
   (CASE WHEN xret > 0 THEN eff_greed * xret * 50.0 ELSE eff_fear * xret * 30.0 END)
   + (CASE WHEN contrarian_factor > 0 THEN contrarian_factor * ABS(xdd) * 20.0 ELSE contrarian_factor * ABS(xdd) * 10.0 END)
   + xgold * 3.0 * eff_greed
   + (1.0 - ABS(contrarian_factor)) * xvp * 5.0
   - ABS(contrarian_factor) * xvp * 3.0
   + (CASE WHEN xrsi < 30 THEN contrarian_factor * 5.0 - (1.0 - contrarian_factor) * 3.0
           WHEN xrsi > 70 THEN eff_greed * 3.0 - contrarian_factor * 4.0 ELSE 0.0 END)
   + contrarian_factor * (-xz) * 4.0
   - (1.0 - risk_tolerance) * xvol * 15.0
   + COALESCE(news_sensitivity * sentiment_mean * 10.0
              - (CASE WHEN sentiment_mean < -0.3 THEN eff_fear * ABS(sentiment_mean) * 8.0 ELSE 0.0 END), 0.0)
   + (CASE WHEN sector_preference = 'ALL' THEN 0.0
           WHEN list_contains(string_split(sector_preference, ','), COALESCE(sector, '')) THEN 3.0 ELSE -1.0 END)
     AS stock_score FROM gr1),
gr3 AS (SELECT gr2.*,
   MAX(stock_score) OVER (PARTITION BY scenario_id, dt, archetype_id) AS smax,
   AVG(stock_score) OVER (PARTITION BY scenario_id, dt, archetype_id) AS smean,
   STDDEV_POP(stock_score) OVER (PARTITION BY scenario_id, dt, archetype_id) AS ssd FROM gr2),
gr4 AS (SELECT gr3.*, EXP((stock_score - smax) / GREATEST(0.5 + risk_tolerance * 1.5, 0.1)) AS e FROM gr3),
gr5 AS (SELECT gr4.*, SUM(e) OVER (PARTITION BY scenario_id, dt, archetype_id ORDER BY ticker
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM gr4),
gr6 AS (SELECT gr5.*, MAX(cum) OVER (PARTITION BY scenario_id, dt, archetype_id) AS tot FROM gr5),
gr7 AS (SELECT gr6.*, cum / tot > {_u('scenario_id', 'dt', 'archetype_id', "'pick'")} AS hit FROM gr6),
sel AS (SELECT * FROM (SELECT gr7.*, ROW_NUMBER() OVER (PARTITION BY scenario_id, dt, archetype_id
                                                       ORDER BY hit DESC, ticker) AS rr FROM gr7) WHERE rr = 1),
pr AS (SELECT sel.*,
   GREATEST(buy_prob + buy_bias + COALESCE(buy_pct, 0.25) * 0.3
            + CASE WHEN xdd < -0.15 AND contrarian_factor > 0.3 THEN 0.15 ELSE 0.0 END, 0.01) AS qb,
   GREATEST(call_prob + COALESCE(call_pct, 0.25) * 0.3
            + CASE WHEN xdd < -0.15 AND contrarian_factor > 0.3 THEN 0.10 ELSE 0.0 END, 0.01) AS qc,
   GREATEST(put_prob + COALESCE(put_pct, 0.25) * 0.3
            + CASE WHEN xdd < -0.15 AND NOT (contrarian_factor > 0.3) THEN 0.10 ELSE 0.0 END, 0.01) AS qp,
   GREATEST(short_prob - buy_bias + COALESCE(short_pct, 0.25) * 0.3
            + CASE WHEN xdd < -0.15 AND NOT (contrarian_factor > 0.3) THEN 0.10 ELSE 0.0 END, 0.01) AS qs,
   {_u('scenario_id', 'dt', 'archetype_id', "'act'")} AS u2 FROM sel),
flows AS (SELECT scenario_id, dt, archetype_id, base_type, ticker AS target_ticker, sector AS target_sector,
   CASE WHEN u2 < qb / (qb + qc + qp + qs) THEN 'BUY'
        WHEN u2 < qb / (qb + qc + qp + qs) + qc / (qb + qc + qp + qs) THEN 'CALL'
        WHEN u2 < qb / (qb + qc + qp + qs) + qc / (qb + qc + qp + qs) + qp / (qb + qc + qp + qs) THEN 'PUT'
        ELSE 'SHORT' END AS action,
   {_r3("LEAST(GREATEST((urgency_base + xgold * 0.08 + COALESCE(realized_vol_20d, 0.0) * 0.5 + COALESCE(ABS(sentiment_mean) * 0.3, 0.0)) * (0.5 + eff_greed * 0.3 + (1.0 - eff_fear) * 0.2), 0.0), 1.0)")} AS urgency,
   {_r3("LEAST(GREATEST((stock_score - smean) / (ssd + 1e-6) * 0.3 + 0.5, 0.0), 1.0)")} AS confidence,
   {_r3("stock_score")} AS stock_score,
   concat_ws('; ', 'Regime=' || regime_label,
             CASE WHEN xgold >= 3 THEN 'score=' || CAST(CAST(xgold AS INTEGER) AS VARCHAR) END,
             CASE WHEN xdd < -0.10 THEN 'drawdown=' || CAST(ROUND(xdd * 1000.0) / 10.0 AS VARCHAR) || '%' END,
             CASE WHEN contrarian_factor > 0.3 THEN 'contrarian_signal' END) AS reasoning,
   regime_label FROM pr)
"""


@register("decision_grid", sql=FLOWS + "SELECT * FROM flows", floats=("urgency", "confidence", "stock_score"),
          ops=("P1", "P2", "P3", "P4", "P5", "P6", "P7", "P8", "C17", "B6", "L14", "C9"))
def q_decision_grid(spark, sf):
    """One decision per (scenario date, archetype): 100 jittered archetypes
    score every instrument of the day, pick one by softmax draw, then an
    action, urgency and confidence."""
    return flows(spark, sf)


@register("flow_aggregates", sql=FLOWS + """
SELECT scenario_id, dt, target_ticker AS ticker, COUNT(*) AS agents,
       COUNT(*) FILTER (WHERE action = 'BUY') AS buy_count, COUNT(*) FILTER (WHERE action = 'CALL') AS call_count,
       COUNT(*) FILTER (WHERE action = 'PUT') AS put_count, COUNT(*) FILTER (WHERE action = 'SHORT') AS short_count,
       SUM(ROUND(urgency * 1000.0)) / (COUNT(*) * 1000.0) AS avg_urgency,
       SUM(ROUND(confidence * 1000.0)) / (COUNT(*) * 1000.0) AS avg_confidence, COUNT(DISTINCT base_type) AS base_types,
       (COUNT(*) FILTER (WHERE action = 'BUY') + COUNT(*) FILTER (WHERE action = 'CALL')) / COUNT(*) AS bullish_ratio,
       COUNT(*) FILTER (WHERE action = 'BUY') + COUNT(*) FILTER (WHERE action = 'CALL')
       - COUNT(*) FILTER (WHERE action = 'PUT') - COUNT(*) FILTER (WHERE action = 'SHORT') AS net_flow
FROM flows GROUP BY scenario_id, dt, target_ticker""",
          floats=("avg_urgency", "avg_confidence", "bullish_ratio"), ops=("D5",))
def q_flow_aggregates(spark, sf):
    """Per (scenario date, instrument) flow counts and ratios."""
    return P.aggregate_flows(flows(spark, sf))


@register("flow_report", sql=FLOWS + """
SELECT scenario_id, action, COUNT(*) AS n, COUNT(DISTINCT target_ticker) AS tickers,
       SUM(ROUND(urgency * 1000.0)) / (COUNT(*) * 1000.0) AS avg_urgency,
       COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY scenario_id) AS pct
FROM flows GROUP BY scenario_id, action""", floats=("avg_urgency", "pct"), ops=("D30", "E34"))
def q_flow_report(spark, sf):
    """Flow summary by scenario and action with share of the scenario."""
    f = flows(spark, sf).groupBy("scenario_id", "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("target_ticker").alias("tickers"),
        (F.sum(F.round(F.col("urgency") * 1000.0)) / (F.count(F.lit(1)) * 1000.0)).alias("avg_urgency"))
    return f.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("scenario_id")))


@register("read_flows", sql=FLOWS + """
SELECT * FROM flows
WHERE scenario_id = 1 AND dt = (SELECT dt FROM (SELECT DISTINCT dt FROM flows WHERE scenario_id = 1) ORDER BY dt OFFSET 5 LIMIT 1)
ORDER BY urgency DESC, archetype_id LIMIT 100""", floats=("urgency", "confidence", "stock_score"), ops=("P9", "H6"))
def q_read_flows(spark, sf):
    """Top 100 decisions by urgency on the 6th date of scenario 1."""
    from ..operators.ranking import nth_date, top_n
    f = flows(spark, sf).filter(F.col("scenario_id") == 1)
    return top_n(nth_date(f, 5), [F.col("urgency").desc(), F.col("archetype_id")], 100)
