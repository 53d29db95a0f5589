"""Registered queries: quality rules and validation checks (M1-M17, A19,
C10, C11, C14)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators import observed as O
from ..operators import quality as M
from ..operators.joins import diff_versions
from ..operators.ranking import latest_per_key
from ..registry import register
from ..session import checkpoint_dir
from ..sources import load, versions
from . import fixtures as FX
from .gold import signal_table
from .silver import daily_features, silver_path, silver_table
from .sqltext import BARS, GOLD, SILVER, with_ctes

G = with_ctes(BARS, SILVER, GOLD)


def _silver(spark, sf):
    return silver_table(spark, sf)


def _gold(spark, sf):
    return signal_table(_silver(spark, sf))


def _rows(layer, items, src):
    """SQL: one check row per (name, value_sql, threshold, passed_sql)."""
    sel = []
    for name, val, thr, ok in items:
        sel.append(f"SELECT '{layer}' AS layer, '{name}' AS name, CAST({val} AS DOUBLE) AS value, "
                   f"'{thr}' AS threshold, COALESCE({ok.format(v=f'CAST({val} AS DOUBLE)')}, FALSE) AS passed FROM {src}")
    return "\nUNION ALL\n".join(sel)


BRONZE_CTE = """
ba AS (SELECT COUNT(*) AS rws, COUNT(DISTINCT ticker) AS tks,
              COUNT(*) FILTER (WHERE ticker IS NULL) AS n_ticker, COUNT(*) FILTER (WHERE dt IS NULL) AS n_dt,
              COUNT(*) FILTER (WHERE close IS NULL) AS n_close, COUNT(*) FILTER (WHERE volume IS NULL) AS n_volume,
              COUNT(*) FILTER (WHERE close < 0) AS neg_close, COUNT(*) FILTER (WHERE volume < 0) AS neg_vol,
              COUNT(DISTINCT sector) AS sectors,
              (SELECT COUNT(*) FROM (SELECT ticker, dt FROM bars GROUP BY 1, 2 HAVING COUNT(*) > 1)) AS dups
       FROM bars)
"""
BRONZE_ROWS = _rows("bronze", [
    ("row_count", "rws", ">100000", "{v} > 100000"), ("distinct_tickers", "tks", ">400", "{v} > 400"),
    ("null_ticker", "n_ticker", "0", "{v} = 0"), ("null_dt", "n_dt", "0", "{v} = 0"),
    ("null_close", "n_close", "0", "{v} = 0"), ("null_volume", "n_volume", "0", "{v} = 0"),
    ("negative_prices", "neg_close", "0", "{v} = 0"), ("negative_volumes", "neg_vol", "0", "{v} = 0"),
    ("duplicate_ticker_dates", "dups", "0", "{v} = 0"), ("sector_count", "sectors", ">=8", "{v} >= 8")], "ba")

SILVER_CTE = """
sa AS (SELECT COUNT(*) AS rws,
  """ + ",\n  ".join(f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100.0 / COUNT(*) AS np_{k}"
                     for k, c in M.SILVER_FEATURES.items()) + """,
  COUNT(*) FILTER (WHERE rsi_14 IS NOT NULL AND (rsi_14 < 0 OR rsi_14 > 100)) AS rsi_bad,
  COUNT(*) FILTER (WHERE realized_vol_20d < 0) AS neg_vol,
  date_diff('day', DATE '1970-01-01', MAX(dt)) AS last_days
  FROM silver)
"""
SILVER_ROWS = _rows("silver", [("row_count", "rws", ">100000", "{v} > 100000")] + [
    (f"null_pct_{k}", f"np_{k}", "<10.0", "{v} < 10.0") for k in M.SILVER_FEATURES] + [
    ("rsi_range", "rsi_bad", "0", "{v} = 0"), ("negative_volatility", "neg_vol", "0", "{v} = 0"),
    ("latest_date_days", "last_days", "", "TRUE")], "sa")

GOLD_CTE = """
ga AS (SELECT COUNT(DISTINCT ticker) AS tks, CAST(COUNT(*) FILTER (WHERE top_tier) AS DOUBLE) * 100.0 / COUNT(*) AS tt,
              COUNT(*) FILTER (WHERE signal_score IS NULL) AS ns,
              COUNT(*) FILTER (WHERE signal_score < 0 OR signal_score > 5) AS bs, COUNT(DISTINCT sector) AS sc
       FROM gold)
"""
GOLD_ROWS = _rows("gold", [("ticker_count", "tks", ">400", "{v} > 400"),
                           ("top_tier_pct", "tt", "(0,10)", "({v} > 0 AND {v} < 10)"),
                           ("null_score", "ns", "0", "{v} = 0"), ("score_range", "bs", "0", "{v} = 0"),
                           ("sector_count", "sc", ">=8", "{v} >= 8")], "ga")


@register("bronze_checks", sql=with_ctes(BARS, BRONZE_CTE) + BRONZE_ROWS, ops=("M1", "M2", "D14"))
def q_bronze(spark, sf):
    """Bar-table rules as (layer, name, value, threshold, passed) rows."""
    return M.bronze_checks(FX.bars_table(spark, sf))


@register("silver_checks", sql=with_ctes(BARS, SILVER, SILVER_CTE) + SILVER_ROWS, floats=("value",),
          ops=("M1", "M3", "M8"))
def q_silver(spark, sf):
    """Feature-table rules."""
    return M.silver_checks(_silver(spark, sf))


@register("gold_checks", sql=G.rstrip() + ",\n" + GOLD_CTE.strip() + "\n" + GOLD_ROWS, floats=("value",),
          ops=("M1", "M4"))
def q_gold(spark, sf):
    """Signal-table rules."""
    return M.gold_checks(_gold(spark, sf))


@register("quality_report", sql=G.rstrip() + ",\n" + BRONZE_CTE.strip() + ",\n" + SILVER_CTE.strip() + ",\n"
          + GOLD_CTE.strip() + ",\nallc AS (" + BRONZE_ROWS + "\nUNION ALL\n" + SILVER_ROWS + "\nUNION ALL\n" + GOLD_ROWS
          + """)
SELECT layer, COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE NOT passed) AS failed_checks,
       CASE WHEN COUNT(*) FILTER (WHERE NOT passed) > 0 THEN 'fail' ELSE 'pass' END AS status
FROM allc GROUP BY layer""", ops=("M6",))
def q_quality_report(spark, sf):
    """Per-layer check summary."""
    b = FX.bars_table(spark, sf)
    s = silver_table(spark, sf)
    checks = M.bronze_checks(b).unionByName(M.silver_checks(s)).unionByName(M.gold_checks(signal_table(s)))
    return M.quality_report(checks)


def _observed_layers(spark, sf):
    """The feature layer and a gold layer, both written with their rules."""
    lower = silver_path(spark, sf)
    upper = O.layer_path(spark, "gold")
    O.write_observed(_gold(spark, sf), upper, {"gold": O.gold_rules()})
    return lower, upper


ALL_CHECKS = G.rstrip() + ",\n" + BRONZE_CTE.strip() + ",\n" + SILVER_CTE.strip() + ",\n" + GOLD_CTE.strip() + ",\nallc AS (" \
    + BRONZE_ROWS + "\nUNION ALL\n" + SILVER_ROWS + "\nUNION ALL\n" + GOLD_ROWS + ")\n"


@register("observed_checks", sql=ALL_CHECKS + "SELECT * FROM allc", floats=("value",), ops=("M1", "M2", "M3", "M4"))
def q_observed_checks(spark, sf):
    """Rules of all layers, measured while the layers were written."""
    return O.read_checks(spark, *_observed_layers(spark, sf))


@register("observed_report", sql=ALL_CHECKS + """
SELECT layer, COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE NOT passed) AS failed_checks,
       CASE WHEN COUNT(*) FILTER (WHERE NOT passed) > 0 THEN 'fail' ELSE 'pass' END AS status
FROM allc GROUP BY layer""", ops=("M6",))
def q_observed_report(spark, sf):
    """The stored report documents of the layers."""
    return O.read_status(spark, *_observed_layers(spark, sf))


@register("layer_integrity", sql=with_ctes(BARS, SILVER) + """
SELECT u.upper_rows, l.lower_rows, k.keys_lost,
       CAST(u.upper_rows - l.lower_rows AS DOUBLE) / u.upper_rows AS loss_ratio,
       CAST(u.upper_rows - l.lower_rows AS DOUBLE) / u.upper_rows < 0.01 AND k.keys_lost <= 2 AS passed
FROM (SELECT COUNT(*) AS upper_rows FROM bars) u,
     (SELECT COUNT(*) AS lower_rows FROM silver WHERE daily_return IS NOT NULL) l,
     (SELECT COUNT(*) AS keys_lost FROM (SELECT DISTINCT ticker FROM bars
        EXCEPT SELECT DISTINCT ticker FROM silver WHERE daily_return IS NOT NULL)) k""",
          floats=("loss_ratio",), ops=("M7", "C12"))
def q_layer_integrity(spark, sf):
    """Row loss between bars and rows with a return; instruments lost."""
    b = FX.bars_table(spark, sf)
    lower = silver_table(spark, sf).filter(F.col("daily_return").isNotNull())
    return M.layer_integrity(b, lower)


@register("orphans", sql="SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
          ops=("M9",))
def q_orphans(spark, sf):
    """Documents without a row in the label table."""
    return M.orphans(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id")


@register("values_match", sql=G + """
SELECT 'close' AS what, COUNT(*) AS compared, COUNT(*) FILTER (WHERE ABS(b.close - s.close) > 0.0001) AS mismatches
FROM bars b JOIN silver s ON b.ticker = s.ticker AND b.dt = s.dt
UNION ALL
SELECT 'open' AS what, COUNT(*) AS compared, COUNT(*) FILTER (WHERE ABS(b.open - s.close) > 0.0001) AS mismatches
FROM bars b JOIN silver s ON b.ticker = s.ticker AND b.dt = s.dt""", ops=("M10", "C10"))
def q_values_match(spark, sf):
    """Feature-table close against the bar table's close (equal on every key)
    and, as the counter-check, against its open."""
    s, b = silver_table(spark, sf), FX.bars_table(spark, sf)
    keys = ["ticker", "dt"]
    same = M.values_match(b, s, keys, "close").withColumn("what", F.lit("close"))
    other = M.values_match(b.select(*keys, F.col("open").alias("close")), s, keys, "close").withColumn("what", F.lit("open"))
    return same.unionByName(other).select("what", "compared", "mismatches")


@register("check_forward", sql=with_ctes(BARS, SILVER) + """
SELECT COUNT(*) FILTER (WHERE fwd_return_5d IS NOT NULL AND re IS NOT NULL AND ABS(fwd_return_5d - re) > 1e-9) AS mismatched,
       COUNT(*) FILTER (WHERE fwd_return_5d IS NOT NULL AND f IS NULL) AS leaked, COUNT(*) AS rows
FROM (SELECT fwd_return_5d, LEAD(close, 5) OVER (PARTITION BY ticker ORDER BY dt) AS f,
             (LEAD(close, 5) OVER (PARTITION BY ticker ORDER BY dt) - close) / NULLIF(close, 0) AS re FROM silver)""",
          ops=("M11",))
def q_check_forward(spark, sf):
    """Lookahead check on the 5-row forward return."""
    return M.check_forward(_silver(spark, sf), 5)


@register("check_backward", sql=with_ctes(BARS, SILVER) + """
SELECT COUNT(*) AS checked, COUNT(*) FILTER (WHERE ABS(bb_mid - m) > 1e-6) AS mismatches
FROM (SELECT bb_mid, AVG(close) OVER w AS m, COUNT(*) OVER w AS c FROM silver
      WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE c = 20""",
          ops=("M12", "E15"))
def q_check_backward(spark, sf):
    """Backward-only check: SMA-20 recomputed on full windows."""
    return M.check_backward(_silver(spark, sf))


@register("check_drawdown", sql=with_ctes(BARS, SILVER) + """
SELECT COUNT(*) FILTER (WHERE drawdown_pct > 0) AS positive_drawdowns, MIN(drawdown_pct) AS deepest_drawdown
FROM silver""", floats=("deepest_drawdown",), ops=("M13",))
def q_check_drawdown(spark, sf):
    """Drawdown is never positive; deepest drawdown."""
    return M.check_drawdown(_silver(spark, sf))


@register("version_diff", sql=with_ctes(BARS, SILVER).rstrip() + """,
v1 AS (SELECT ticker, dt, rsi_14 AS rsi_a FROM silver WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'),
v2 AS (SELECT ticker, dt, FLOOR(rsi_14) AS rsi_b FROM silver WHERE dt BETWEEN DATE '1996-02-01' AND DATE '1996-04-30')
SELECT COALESCE(v1.ticker, v2.ticker) AS ticker, COALESCE(v1.dt, v2.dt) AS dt, rsi_a AS rsi_14_a, rsi_b AS rsi_14_b,
       CASE WHEN v1.ticker IS NULL THEN 'added' WHEN v2.ticker IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM v1 FULL OUTER JOIN v2 ON v1.ticker = v2.ticker AND v1.dt = v2.dt
WHERE v1.ticker IS NULL OR v2.ticker IS NULL OR rsi_a IS DISTINCT FROM rsi_b""",
          floats=("rsi_14_a", "rsi_14_b"), ops=("M14", "C11", "A19", "A6"))
def q_version_diff(spark, sf):
    """Diff of two committed versions of a feature table: the second one is a
    month later and stores whole numbers."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/versions/rsi-{uuid.uuid4().hex}"
    s = silver_table(spark, sf).select("ticker", "dt", "rsi_14")
    first = versions.write(s.filter("dt BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'"), path)
    later = s.filter("dt BETWEEN DATE '1996-02-01' AND DATE '1996-04-30'").withColumn("rsi_14", F.floor("rsi_14").cast("double"))
    second = versions.write(later, path, based_on=first)
    return diff_versions(versions.read(spark, path, first), versions.read(spark, path, second), ["ticker", "dt"], ["rsi_14"])


@register("version_history", sql=with_ctes(BARS) + """
SELECT CAST(v AS BIGINT) AS version, (SELECT COUNT(*) FROM bars WHERE dt >= DATE '1996-01-01' AND dt < DATE '1996-02-01' + to_months(CAST(v AS INTEGER))) AS rows,
       'append' AS operation FROM range(3) t(v)""", ops=("A19",))
def q_version_history(spark, sf):
    """History of a table committed month by month: each version's rows."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/versions/bars-{uuid.uuid4().hex}"
    b = FX.bars_table(spark, sf).select("ticker", "dt", "close")
    for month in ("1996-01", "1996-02", "1996-03"):
        versions.write(b.filter(F.date_format("dt", "yyyy-MM") == month), path, "append")
    counts = [versions.read(spark, path, v).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("rows")) for v in range(3)]
    return reduce(lambda x, y: x.unionByName(y), counts).join(versions.history(spark, path).select("version", "operation"), "version")


@register("regime_share", sql=with_ctes(BARS, SILVER).rstrip() + """,
r AS (SELECT dt, """ + FX.REGIME_SQL + """
                        ELSE 'Neutral' END AS regime_label FROM silver WHERE ticker = 'MKT'
                        AND dt BETWEEN DATE '1996-01-01' AND DATE '1996-12-31')
SELECT regime_label, COUNT(*) AS days, COUNT(*) * 100.0 / SUM(COUNT(*)) OVER () AS pct FROM r GROUP BY regime_label
""", floats=("pct",), ops=("M15",))
def q_regime_share(spark, sf):
    """Regime composition of 1996."""
    return M.regime_share(FX.regimes(_silver(spark, sf)), "1996-01-01", "1996-12-31")


@register("pipeline_status", sql=G + """
SELECT g.dates_processed, g.first_processed, g.last_processed, s.dates_available, s.last_available,
       s.dates_available - g.dates_processed AS dates_remaining
FROM (SELECT COUNT(DISTINCT dt) AS dates_processed, MIN(dt) AS first_processed, MAX(dt) AS last_processed
      FROM gold WHERE signal_score >= 1) g,
     (SELECT COUNT(DISTINCT dt) AS dates_available, MAX(dt) AS last_available FROM silver) s""", ops=("M16",))
def q_pipeline_status(spark, sf):
    """Dates with signals vs dates available."""
    s = _silver(spark, sf)
    return M.pipeline_status(signal_table(s).filter(F.col("signal_score") >= 1), s)


@register("build_quality", sql=G.rstrip() + """,
lt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rr FROM gold) WHERE rr = 1)
SELECT COUNT(*) AS stocks, COUNT(*) FILTER (WHERE signal_score > 0) AS with_signal,
       COUNT(*) FILTER (WHERE top_tier) AS top_tier, COUNT(*) FILTER (WHERE close <= 0) AS bad_price,
       COUNT(*) FILTER (WHERE sector IS NULL) AS no_sector FROM lt""", ops=("M17",))
def q_build_quality(spark, sf):
    """Counters over each instrument's latest row."""
    return M.build_quality(latest_per_key(_gold(spark, sf)))
