"""Registered queries: latest-row features, sector reports, universe,
leaderboards, feeds, news enrichment, article ingest (A10, C7, E37, F9,
F13-F15, H5, H7, H8, K5, K6, P12, G5, C8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators.aggregates import coverage
from ..operators.news import daily_news, explode_matches, news_rolling
from ..operators.ranking import latest_per_key, top_n
from ..operators.signals import approx_distribution, direction_bias_momentum, news_attention
from ..registry import register
from ..sources import load
from ..sources.files import ingest_articles
from . import fixtures as FX
from .catalog_text import ARTICLES, DAILY_NEWS, EXPLODED
from .gold import signal_table
from .silver import daily_features, silver_table
from .sqltext import BARS, GOLD, SILVER, with_ctes

G = with_ctes(BARS, SILVER, GOLD)


def _r(x, d):
    return f"(ROUND(({x}) * {float(10 ** d)!r}) / {float(10 ** d)!r})"


@register("latest_features", sql=with_ctes(BARS).rstrip() + f""",
x AS (SELECT ticker, dt, close, volume,
             (close - LAG(close) OVER w) / NULLIF(LAG(close) OVER w, 0) AS r,
             ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rd
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
d AS (SELECT ticker, GREATEST(MAX(COALESCE((pk - close) / NULLIF(pk, 0), 0.0)), 0.0) AS max_drawdown
      FROM (SELECT ticker, close, MAX(close) OVER (PARTITION BY ticker ORDER BY dt
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk
            FROM x WHERE rd <= 60) GROUP BY ticker),
a AS (SELECT ticker, COUNT(*) AS n, MAX(CASE WHEN rd = 1 THEN close END) AS last,
             MAX(CASE WHEN rd = 21 THEN close END) AS c20, ARG_MIN(close, dt) AS c0,
             SQRT(AVG(CASE WHEN rd <= 20 THEN r * r END)) AS vol, MAX(CASE WHEN rd = 1 THEN volume END) AS vlast,
             CAST(SUM(CASE WHEN rd BETWEEN 2 AND 21 THEN volume END) AS DOUBLE) AS v20,
             AVG(CASE WHEN rd <= 60 THEN r END) AS m1, AVG(CASE WHEN rd <= 60 THEN r * r END) AS m2,
             AVG(CASE WHEN rd <= 60 THEN r * r * r END) AS m3, COUNT(CASE WHEN rd <= 60 THEN r END) AS nsk
      FROM x GROUP BY ticker),
f AS (SELECT a.ticker, n AS history_len, last AS price,
             COALESCE((last - CASE WHEN n > 20 THEN c20 ELSE c0 END) / NULLIF(CASE WHEN n > 20 THEN c20 ELSE c0 END, 0), 0.0) AS ret_20d,
             CASE WHEN n >= 20 THEN COALESCE(vol, 0.0) ELSE 0.0 END AS volatility, d.max_drawdown,
             CASE WHEN n >= 20 AND vlast > 0 THEN vlast / CASE WHEN v20 > 0 THEN v20 / 20.0 ELSE 1.0 END ELSE 1.0 END AS vol_spike,
             CASE WHEN n >= 30 AND nsk > 2 THEN COALESCE((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / NULLIF(POW(m2 - m1 * m1, 1.5), 0), 0.0)
                  ELSE 0.0 END AS skewness
      FROM a JOIN d ON a.ticker = d.ticker WHERE n >= 50),
s AS (SELECT f.*, (CASE WHEN max_drawdown > 0.15 THEN 1 ELSE 0 END)
                  + (CASE WHEN max_drawdown > 0.10 AND vol_spike > 2.0 THEN 1 ELSE 0 END)
                  + (CASE WHEN skewness > 0.5 THEN 1 ELSE 0 END)
                  + (CASE WHEN ret_20d < -0.10 AND volatility < 0.05 THEN 1 ELSE 0 END) AS s0 FROM f)
SELECT ticker, history_len, {_r('price', 2)} AS price, {_r('ret_20d', 4)} AS ret_20d, {_r('volatility', 4)} AS volatility,
       {_r('max_drawdown', 4)} AS max_drawdown, {_r('vol_spike', 2)} AS vol_spike, {_r('skewness', 3)} AS skewness,
       s0 + CASE WHEN s0 >= 3 AND skewness > 0.8 THEN 1 ELSE 0 END AS simple_score,
       s0 + CASE WHEN s0 >= 3 AND skewness > 0.8 THEN 1 ELSE 0 END >= 4 AS top_tier
FROM s""", ops=("E37", "F13", "L12", "L13"))
def q_latest_features(spark, sf):
    """Features of each instrument's latest history and the simple score."""
    return R.latest_features(FX.bars_table(spark, sf))


LATEST = G.rstrip() + """,
lt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rr FROM gold) WHERE rr = 1)
"""


@register("sector_reports", sql=LATEST + """,
x AS (SELECT *, AVG(signal_score) OVER s AS avg_gs, AVG(drawdown_pct) OVER s AS avg_dd,
             AVG(COALESCE(fwd_60d_median, 0.0)) OVER s AS avg_fwd, AVG(vol_percentile) OVER s AS avg_vol,
             COALESCE(AVG(rsi_14) OVER s, 50.0) AS avg_rsi,
             ROW_NUMBER() OVER (PARTITION BY sector ORDER BY signal_score DESC, drawdown_pct ASC, ticker) AS pick
      FROM lt WINDOW s AS (PARTITION BY sector))
SELECT sector,
  CASE WHEN (avg_rsi > 55 AND avg_fwd > 0.01) OR avg_gs > 3 THEN 'bullish'
       WHEN (avg_rsi < 40 AND avg_dd < -0.12) OR avg_fwd < -0.02 THEN 'bearish' ELSE 'neutral' END AS sector_sentiment,
  CASE WHEN avg_vol > 0.7 THEN 'high' WHEN avg_vol > 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
  pick, ticker,
  CASE WHEN drawdown_pct < -0.1 AND signal_score >= 2 THEN 'BUY' WHEN avg_rsi > 70 THEN 'PUT'
       WHEN COALESCE(fwd_60d_median, 0.0) > 0.03 THEN 'CALL' WHEN COALESCE(fwd_60d_median, 0.0) < -0.02 THEN 'SHORT'
       ELSE 'BUY' END AS action,
  LEAST(100, CAST(ROUND(30.0 + signal_score * 12.0 + ABS(drawdown_pct) * 50.0) AS INTEGER)) AS conviction
FROM x WHERE pick <= 3""", ops=("P12", "H2"))
def q_sector_reports(spark, sf):
    """Per-sector sentiment, risk and top-3 picks from the latest rows."""
    g = latest_per_key(signal_table(silver_table(spark, sf)))
    return R.sector_reports(g)


@register("select_universe", sql=with_ctes(BARS) + """
SELECT ticker, COUNT(*) AS rows, MIN(dt) AS first_date, MAX(dt) AS last_date, AVG(volume) AS avg_volume
FROM bars GROUP BY ticker HAVING COUNT(*) >= 200 ORDER BY avg_volume DESC, ticker LIMIT 10""",
          floats=("avg_volume",), ops=("H5",))
def q_select_universe(spark, sf):
    """Top 10 instruments by mean volume among those with >= 200 bars."""
    c = coverage(FX.bars_table(spark, sf)).withColumn("history_len", F.col("rows"))
    return R.select_universe(c, 10).drop("history_len")


TRADES = """
trades AS (SELECT user_id AS agent_id, event_id AS trade_id, ts, value - 10.0 AS profit FROM events)
"""


def _trades(spark, sf):
    return load(spark, sf, "events").select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("trade_id"),
                                            "ts", (F.col("value") - 10.0).alias("profit"))


@register("leaderboard", sql=with_ctes(TRADES).rstrip() + """,
rc AS (SELECT agent_id, list(trade_id ORDER BY rr) AS last_trades FROM (
         SELECT agent_id, trade_id, ROW_NUMBER() OVER (PARTITION BY agent_id ORDER BY ts DESC, trade_id DESC) AS rr
         FROM trades) WHERE rr <= 8 GROUP BY agent_id),
tt AS (SELECT agent_id, SUM(profit) AS total_profit, COUNT(*) AS total_trades,
              COUNT(*) FILTER (WHERE profit >= 0) / COUNT(*) AS win_rate FROM trades GROUP BY agent_id)
SELECT tt.*, rc.last_trades, ROW_NUMBER() OVER (ORDER BY total_profit DESC, tt.agent_id) AS rank
FROM tt JOIN rc ON tt.agent_id = rc.agent_id""", floats=("total_profit", "win_rate"), ops=("H7",))
def q_leaderboard(spark, sf):
    """Agents (event users, P&L = value - 10) ranked by total profit, with
    win rate and their last 8 trades."""
    return R.leaderboard(_trades(spark, sf))


@register("keep_last", sql=with_ctes(TRADES) + """
SELECT agent_id, trade_id, profit FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id ORDER BY ts DESC, trade_id DESC) AS rr FROM trades)
WHERE rr <= 20""", floats=("profit",), ops=("H8",))
def q_keep_last(spark, sf):
    """Newest 20 trades per agent."""
    from ..operators.ranking import top_k_per_group
    t = _trades(spark, sf)
    return top_k_per_group(t, "agent_id", [F.col("ts").desc(), F.col("trade_id").desc()], 20) \
        .select("agent_id", "trade_id", "profit")


@register("long_short_picks", sql=LATEST + """
SELECT 'long' AS side, ticker, signal_score, drawdown_pct FROM (
  SELECT * FROM lt ORDER BY signal_score DESC, drawdown_pct, ticker LIMIT 3)
UNION ALL
SELECT 'short' AS side, ticker, signal_score, drawdown_pct FROM (
  SELECT * FROM lt ORDER BY signal_score, drawdown_pct DESC, ticker LIMIT 3)""",
          floats=("drawdown_pct",), ops=("K5", "K6", "H3"))
def q_long_short(spark, sf):
    """Union of long picks (highest score) and short picks (lowest)."""
    g = latest_per_key(signal_table(silver_table(spark, sf))).select(
        "ticker", "signal_score", "drawdown_pct")
    lo = top_n(g, [F.col("signal_score").desc(), F.col("drawdown_pct"), F.col("ticker")], 3) \
        .withColumn("side", F.lit("long"))
    sh = top_n(g, [F.col("signal_score"), F.col("drawdown_pct").desc(), F.col("ticker")], 3) \
        .withColumn("side", F.lit("short"))
    return R.event_feed(lo, sh).select("side", "ticker", "signal_score", "drawdown_pct")


@register("bias_fallback", sql=LATEST + """
SELECT ticker,
  CASE WHEN COALESCE(roc_5, 0.0) > 0 THEN 0.35 ELSE 0.2 END AS buy_pct,
  CASE WHEN COALESCE(drawdown_pct, 0.0) < -0.1 THEN 0.3 ELSE 0.25 END AS call_pct,
  ROUND(GREATEST(1.0 - (CASE WHEN COALESCE(roc_5, 0.0) > 0 THEN 0.35 ELSE 0.2 END)
                 - (CASE WHEN COALESCE(roc_5, 0.0) > 0 THEN 0.15 ELSE 0.3 END)
                 - (CASE WHEN COALESCE(drawdown_pct, 0.0) < -0.1 THEN 0.3 ELSE 0.25 END), 0.05), 2) AS put_pct,
  CASE WHEN COALESCE(roc_5, 0.0) > 0 THEN 0.15 ELSE 0.3 END AS short_pct,
  CASE WHEN realized_vol_20d IS NOT NULL AND realized_vol_20d <> 0 THEN COALESCE(fwd_return_60d, 0.0) - realized_vol_20d * 1.6 ELSE -0.08 END AS p5,
  CASE WHEN realized_vol_20d IS NOT NULL AND realized_vol_20d <> 0 THEN COALESCE(fwd_return_60d, 0.0) + realized_vol_20d * 1.6 ELSE 0.12 END AS p95,
  COALESCE(roc_5, 0.0) * 0.5 AS skew
FROM lt""", floats=("buy_pct", "call_pct", "put_pct", "short_pct", "p5", "p95", "skew"), ops=("F9", "F14"))
def q_bias_fallback(spark, sf):
    """Momentum/drawdown bias heuristic and the sketched forward distribution
    on each instrument's latest row."""
    g = latest_per_key(signal_table(silver_table(spark, sf)))
    b = direction_bias_momentum()
    d = approx_distribution()
    return g.select("ticker", *[v.alias(k) for k, v in b.items()], d["p5"].alias("p5"), d["p95"].alias("p95"),
                    d["skew"].alias("skew"))


@register("enrich_news", sql=with_ctes(BARS, SILVER, FX.SCENARIO_SQL, FX.INSTRUMENT_NEWS_SQL) + """,
dn0 AS (SELECT sticker, sdt, COUNT(*) AS news_count, AVG(tone / CAST(10 AS DOUBLE)) AS avg_news_tone,
               COALESCE(STDDEV_SAMP(tone / CAST(10 AS DOUBLE)), 0.0) AS std_news_tone FROM inews GROUP BY sticker, sdt),
dn AS (SELECT *, STDDEV_SAMP(news_count) OVER w AS s7, AVG(news_count) OVER w AS m7 FROM dn0
       WINDOW w AS (PARTITION BY sticker ORDER BY sdt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT s.ticker, s.dt, COALESCE(n.news_count, 0) AS news_count, COALESCE(n.avg_news_tone, 0.0) AS avg_news_tone,
       COALESCE(n.std_news_tone, 0.0) AS std_news_tone, n.news_count IS NOT NULL AS has_news,
       CASE WHEN n.news_count IS NOT NULL THEN 0.5 * ABS(CASE WHEN s7 > 0 THEN (news_count - m7) / s7 ELSE 0.0 END) + 0.3 * ABS(n.avg_news_tone) + 0.2 * n.std_news_tone
            ELSE 0.0 END AS news_attention_score
FROM silver s LEFT JOIN dn n ON s.ticker = n.sticker AND s.dt = n.sdt""",
          floats=("avg_news_tone", "std_news_tone", "news_attention_score"), ops=("C7", "F15", "B3"))
def q_enrich_news(spark, sf):
    """Bars enriched with daily news features (left join, defaults filled)
    and the attention score."""
    b = FX.bars_table(spark, sf).select("ticker", "dt")
    tone = F.col("tone") / F.lit(10.0)
    dn = FX.instrument_news(spark, sf).groupBy("ticker", "dt").agg(
        F.count(F.lit(1)).alias("news_count"), F.avg(tone).alias("avg_news_tone"), F.coalesce(F.stddev_samp(tone), F.lit(0.0)).alias("std_news_tone"))
    dn = news_rolling(dn, t="dt").select("ticker", "dt", "news_count", "avg_news_tone", "std_news_tone", "news_count_zscore")
    j = b.join(dn, ["ticker", "dt"], "left").withColumn("has_news", F.col("news_count").isNotNull())
    j = j.fillna({"news_count": 0, "avg_news_tone": 0.0, "std_news_tone": 0.0, "news_count_zscore": 0.0})
    return j.select("ticker", "dt", "news_count", "avg_news_tone", "std_news_tone", "has_news",
                    news_attention("has_news", "news_count_zscore", "avg_news_tone", "std_news_tone")
                    .alias("news_attention_score"))


@register("ingest_articles", sql=with_ctes(ARTICLES) + """
SELECT url, COALESCE(title, '') AS title, COALESCE(source, '') AS source, published_date,
       COALESCE(language, '') AS language, COALESCE(tone, 0.0) AS tone, scenario FROM articles""",
          floats=("tone",), ops=("A10", "B3", "B13"))
def q_ingest_articles(spark, sf):
    """Typed article rows with defaults (the ingest timestamp is left out of
    the compared columns)."""
    return ingest_articles(FX.articles(spark, sf)).drop("ingested_at")


@register("ml_bias", ops=("C8", "F9"))
def q_ml_bias(spark, sf):
    """Model action probabilities where the model scored the row, else the
    momentum heuristic."""
    from ..operators import ml as N
    from .catalog_ml import FEATURES, action_boost
    s = silver_table(spark, sf)
    model = action_boost(spark, sf)
    # Every row with complete features is scored; only training needs labels.
    scored = N.score_actions(model, latest_per_key(s).dropna(subset=FEATURES)).select(
        "ticker", "dt", "prob_buy", "prob_call", "prob_put", "prob_short")
    g = latest_per_key(signal_table(s)).select("ticker", "dt", "roc_5", "drawdown_pct")
    j = g.join(scored, ["ticker", "dt"], "left")
    h = direction_bias_momentum()
    has = F.col("prob_buy").isNotNull()
    return j.select("ticker", "dt", F.when(has, "model").otherwise("heuristic").alias("bias_source"),
                    *[F.when(has, F.col(f"prob_{a}")).otherwise(h[f"{a}_pct"]).alias(f"{a}_pct")
                      for a in ("buy", "call", "put", "short")])


def _latest_gold(spark, sf):
    return latest_per_key(signal_table(silver_table(spark, sf)))


ALLOC = LATEST.rstrip() + """,
mom AS (SELECT 'momentum' AS fund, ticker, 1.0 / COUNT(*) OVER () AS weight,
               CASE WHEN rsi_14 > 70 THEN 'CALL' ELSE 'BUY' END AS action
        FROM (SELECT * FROM lt WHERE rsi_14 > 55 AND macd_histogram > 0 ORDER BY rsi_14 DESC, ticker LIMIT 8)),
val AS (SELECT 'value' AS fund, ticker, 1.0 / COUNT(*) OVER () AS weight, 'BUY' AS action
        FROM (SELECT * FROM lt WHERE drawdown_pct < -0.08 AND signal_score >= 1 ORDER BY drawdown_pct, ticker LIMIT 8)),
sh AS (SELECT 'contrarian' AS fund, ticker, 0.12 AS weight, 'SHORT' AS action
       FROM (SELECT * FROM lt WHERE rsi_14 > 72 ORDER BY rsi_14 DESC, ticker LIMIT 4)),
lg AS (SELECT 'contrarian' AS fund, ticker, 0.13 AS weight, 'BUY' AS action
       FROM (SELECT * FROM lt WHERE rsi_14 < 32 ORDER BY rsi_14, ticker LIMIT 4)),
alloc AS (SELECT * FROM mom UNION ALL SELECT * FROM val UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM lg)
"""


@register("fund_allocations", sql=ALLOC + "SELECT fund, ticker, weight, action FROM alloc", floats=("weight",),
          ops=("H3", "K5"))
def q_fund_allocations(spark, sf):
    """Momentum, value and contrarian books over the latest snapshot."""
    return R.fund_allocations(_latest_gold(spark, sf))


@register("fund_profit", sql=ALLOC + """
SELECT a.fund, SUM(CASE WHEN a.action = 'CALL' THEN COALESCE(l.fwd_60d_median, 0.0) * 1.5
                        WHEN a.action IN ('SHORT', 'PUT') THEN -COALESCE(l.fwd_60d_median, 0.0)
                        ELSE COALESCE(l.fwd_60d_median, 0.0) END * a.weight) * 10000.0 AS profit,
       COUNT(*) AS positions
FROM alloc a JOIN lt l ON a.ticker = l.ticker GROUP BY a.fund""", floats=("profit",), digits=4, ops=("P11",))
def q_fund_profit(spark, sf):
    """Book profit from the forward median returns."""
    lt = _latest_gold(spark, sf)
    return R.fund_profit(R.fund_allocations(lt), lt)


@register("risk_review", sql=ALLOC.rstrip() + """,
j AS (SELECT a.*, l.drawdown_pct, l.realized_vol_20d, a.weight > 0.25 AS flag_oversized,
             a.action IN ('SHORT', 'PUT') AND l.drawdown_pct < -0.2 AS flag_short_in_drawdown,
             l.realized_vol_20d > 0.4 AND a.weight > 0.15 AS flag_hot
      FROM alloc a LEFT JOIN lt l ON a.ticker = l.ticker),
k AS (SELECT *, CASE WHEN flag_hot THEN LEAST(w1, 0.15) ELSE w1 END AS w2 FROM (
        SELECT *, CASE WHEN flag_short_in_drawdown THEN 0.0 ELSE LEAST(weight, 0.25) END AS w1 FROM j)),
m AS (SELECT *, SUM(CASE WHEN action IN ('SHORT', 'PUT') THEN w2 ELSE 0.0 END) OVER (PARTITION BY fund) AS st FROM k),
n AS (SELECT *, CASE WHEN action IN ('SHORT', 'PUT') AND st > 0.4 THEN w2 * 0.4 / st ELSE w2 END AS w3 FROM m)
SELECT fund, ticker, weight, action, drawdown_pct, realized_vol_20d, flag_oversized, flag_short_in_drawdown, flag_hot,
       CASE WHEN SUM(w3) OVER (PARTITION BY fund) > 0 THEN w3 / SUM(w3) OVER (PARTITION BY fund) ELSE 0.0 END
         AS adjusted_weight
FROM n""", floats=("weight", "drawdown_pct", "realized_vol_20d", "adjusted_weight"),
          ops=("P13",))
def q_risk_review(spark, sf):
    """Risk predicates and reweighted books."""
    lt = _latest_gold(spark, sf)
    return R.risk_review(R.fund_allocations(lt), lt)


@register("apportion", sql=LATEST.rstrip() + """,
x AS (SELECT ticker, signal_score, FLOOR(10.0 + signal_score * signal_score * 20.0) AS raw FROM lt),
y AS (SELECT *, GREATEST(1, CAST(ROUND(raw * (1000.0 / GREATEST(SUM(raw) OVER (), 1))) AS BIGINT)) AS a FROM x),
z AS (SELECT *, 1000 - SUM(a) OVER () AS diff, ROW_NUMBER() OVER (ORDER BY ticker) AS i,
             COALESCE(SUM(a - 1) OVER (ORDER BY ticker ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS cap_after
      FROM y)
SELECT ticker, signal_score, raw,
       CAST(CASE WHEN diff > 0 THEN CASE WHEN i = 1 THEN a + diff ELSE a END
                 ELSE a - LEAST(a - 1, GREATEST(0, -diff - cap_after)) END AS BIGINT) AS units
FROM z""", floats=("raw",), ops=("P15",))
def q_apportion(spark, sf):
    """1000 agents apportioned over instruments by score."""
    return R.apportion(_latest_gold(spark, sf), 1000)


@register("lane_counts", sql=LATEST + """
SELECT ticker, total, door, inside, b AS buy, c AS call, p AS put, GREATEST(0, inside - b - c - p) AS short FROM (
  SELECT *, CAST(ROUND(inside * buy_pct) AS BIGINT) AS b, CAST(ROUND(inside * call_pct) AS BIGINT) AS c,
         CAST(ROUND(inside * put_pct) AS BIGINT) AS p FROM (
    SELECT *, total - door AS inside FROM (
      SELECT *, CAST(ROUND(total * 0.25) AS BIGINT) AS door FROM (
        SELECT ticker, buy_pct, call_pct, put_pct,
               GREATEST(1, CAST(ROUND(5.0 + signal_score * 8.0 + ABS(COALESCE(drawdown_pct, 0.0)) * 20.0) AS BIGINT))
                 AS total FROM lt))))""", ops=("P16",))
def q_lane_counts(spark, sf):
    """Crowd size per instrument split into door and bias lanes."""
    return R.lane_counts(_latest_gold(spark, sf))


@register("approx_median_drawdown", ops=("D8",))
def q_approx_median(spark, sf):
    """Approximate median drawdown per instrument (percentile_approx)."""
    from ..operators.aggregates import approx_quantile_by
    return approx_quantile_by(silver_table(spark, sf), "ticker", "drawdown_pct", 0.5)


@register("describe_bars", ops=("D33",))
def q_describe(spark, sf):
    """count/mean/stddev/min/max of every bar column."""
    from ..operators.aggregates import describe
    return describe(FX.bars_table(spark, sf))


@register("project_forward", sql=LATEST + """
SELECT ticker, GREATEST(0.05, bv * 0.55 / tot) AS buy_pct, GREATEST(0.05, bv * 0.45 / tot) AS call_pct,
       GREATEST(0.05, (1.0 - bv) * 0.5 / tot) AS put_pct, GREATEST(0.05, (1.0 - bv) * 0.5 / tot) AS short_pct,
       gs AS projected_score, pdd AS projected_drawdown,
       gs >= 1 AS projected_signal_1, gs >= 2 AS projected_signal_2, gs >= 3 AS projected_signal_3,
       gs >= 4 AS projected_signal_4, gs >= 5 AS projected_signal_5
FROM (SELECT *, bv * 0.55 + bv * 0.45 + (1.0 - bv) * 0.5 + (1.0 - bv) * 0.5 AS tot FROM (
  SELECT ticker,
         LEAST(GREATEST(0.5 + COALESCE(fwd_60d_median, 0.0) * P * 3.0, 0.1), 0.9) AS bv,
         CAST(LEAST(GREATEST(FLOOR(signal_score + (COALESCE(fwd_60d_skew, 0.0) * P * 0.5
                                                   + COALESCE(fwd_60d_median, 0.0) * P * 2.0) + 0.5), 0), 5) AS INTEGER) AS gs,
         LEAST(GREATEST(drawdown_pct + COALESCE(fwd_60d_median, 0.0) * P, -0.5), 0.0) AS pdd
  FROM (SELECT *, CAST('""" + repr(90 / 365.0) + """' AS DOUBLE) AS P FROM lt)))""",
          floats=("buy_pct", "call_pct", "put_pct", "short_pct", "projected_drawdown"), ops=("F16",))
def q_project_forward(spark, sf):
    """Bias, score, drawdown and tickets projected 90 days ahead."""
    return R.project_forward(_latest_gold(spark, sf), 90)


@register("sector_filter", sql=G + """
SELECT ticker, dt, sector, signal_score FROM gold WHERE sector IN ('ASIA', 'EUROPE') AND signal_score >= 1""",
          ops=("B7",))
def q_sector_filter(spark, sf):
    """Rows of a sector set with at least one signal (membership filter)."""
    g = signal_table(silver_table(spark, sf))
    return g.filter(F.col("sector").isin("ASIA", "EUROPE") & (F.col("signal_score") >= 1)).select(
        "ticker", "dt", "sector", "signal_score")


@register("payload_checks", ops=("M5", "M1"))
def q_payload_checks(spark, sf):
    """Rules over the emitted snapshot and graph documents."""
    from .catalog_docs import q_graph_payload, q_snapshot
    return R.payload_checks(q_snapshot(spark, sf), q_graph_payload(spark, sf), FX.instrument_news(spark, sf))
