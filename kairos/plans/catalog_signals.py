"""Registered queries: signals, scores, tiers and their reports (B8-B10,
B15, D1, D6, D7, D10, D11, D14-D16, D18-D24, D29, D32, E32, E33, F1-F11,
H1, H2, H6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as D
from ..operators import ranking as H
from ..operators.windows import with_returns
from ..registry import register
from ..sources import load
from . import fixtures as FX
from .gold import signal_table
from .silver import daily_features, silver_table
from .sqltext import BARS, GOLD, SILVER, with_ctes

G = with_ctes(BARS, SILVER, GOLD)
FLAGS = ["signal_1", "signal_2", "signal_3", "signal_4", "signal_5"]


def gold(spark, sf):
    return signal_table(silver_table(spark, sf))


@register("signals", sql=G + f"SELECT ticker, dt, {', '.join(FLAGS)}, signal_score FROM gold",
          ops=("F1", "F2", "F3", "F4", "F5", "F6", "B1"))
def q_signals(spark, sf):
    """The five threshold flags and their sum."""
    return gold(spark, sf).select("ticker", "dt", *FLAGS, "signal_score")


@register("rarity_top_tier", sql=G + "SELECT ticker, dt, rarity_percentile, top_tier FROM gold",
          floats=("rarity_percentile",), ops=("E32", "F7"))
def q_rarity(spark, sf):
    """Per-date rarity rank and the top-tier flag."""
    return gold(spark, sf).select("ticker", "dt", "rarity_percentile", "top_tier")


@register("direction_bias", sql=G + "SELECT ticker, dt, buy_pct, call_pct, put_pct, short_pct FROM gold",
          floats=("buy_pct", "call_pct", "put_pct", "short_pct"), ops=("F8", "B2"))
def q_bias(spark, sf):
    """Four direction weights from the forward distribution branch table."""
    return gold(spark, sf).select("ticker", "dt", "buy_pct", "call_pct", "put_pct", "short_pct")


@register("size_density",
          sql=G + "SELECT ticker, dt, size_percentile, width, height, depth, glow, density, speed FROM gold",
          floats=("size_percentile", "width", "height", "depth", "glow", "speed"),
          ops=("E33", "F10", "F11", "B14"))
def q_size(spark, sf):
    """Size rank, footprint, density and speed."""
    return gold(spark, sf).select("ticker", "dt", "size_percentile", "width", "height", "depth",
                                  "glow", "density", "speed")


@register("score_distribution", sql=G + """
SELECT b.signal_score, COALESCE(c.n, 0) AS n,
       COALESCE(c.n, 0) * 100.0 / SUM(COALESCE(c.n, 0)) OVER () AS pct
FROM (SELECT CAST(range AS INTEGER) AS signal_score FROM range(0, 6)) b
LEFT JOIN (SELECT signal_score, COUNT(*) AS n FROM gold GROUP BY signal_score) c
  ON b.signal_score = c.signal_score""", floats=("pct",), ops=("D10", "E34"))
def q_score_distribution(spark, sf):
    """Histogram of the score incl. empty bins, with share of total."""
    return D.score_distribution(gold(spark, sf))


@register("returns_by_score", sql=G + """
SELECT signal_score, COUNT(*) AS n, QUANTILE_CONT(fwd_60d_median, 0.5) AS median_fwd,
       AVG(fwd_60d_median) AS mean_fwd
FROM gold GROUP BY signal_score""", floats=("median_fwd", "mean_fwd"), ops=("D18",))
def q_returns_by_score(spark, sf):
    """Tier back-test: count, median and mean forward value by score."""
    return D.returns_by_score(gold(spark, sf))


@register("flagged_vs_baseline", sql=G + """
SELECT COALESCE(QUANTILE_CONT(fwd_60d_median, 0.5) FILTER (WHERE signal_score >= 1), 0.0) AS flagged_median,
       COALESCE(QUANTILE_CONT(fwd_60d_median, 0.5) FILTER (WHERE signal_score = 0), 0.0) AS baseline_median,
       COUNT(*) FILTER (WHERE signal_score >= 1) AS flagged_count,
       COUNT(*) FILTER (WHERE signal_score = 0) AS baseline_count,
       COALESCE(QUANTILE_CONT(fwd_60d_median, 0.5) FILTER (WHERE signal_score >= 1), 0.0)
       - COALESCE(QUANTILE_CONT(fwd_60d_median, 0.5) FILTER (WHERE signal_score = 0), 0.0) AS alpha
FROM gold""", floats=("flagged_median", "baseline_median", "alpha"), ops=("D19",))
def q_flagged_vs_baseline(spark, sf):
    """Median forward value of flagged rows vs the rest, and the gap."""
    return D.flagged_vs_baseline(gold(spark, sf))


@register("signal_precision", sql=G + """
SELECT signal, COUNT(*) AS holders,
       COUNT(*) FILTER (WHERE fwd_60d_median > 0) / COUNT(*) AS precision,
       COALESCE(AVG(fwd_60d_median), 0.0) AS avg_fwd
FROM (UNPIVOT (SELECT fwd_60d_median, signal_1, signal_2, signal_3, signal_4, signal_5 FROM gold)
      ON signal_1, signal_2, signal_3, signal_4, signal_5 INTO NAME signal VALUE held)
WHERE held GROUP BY signal""", floats=("precision", "avg_fwd"), ops=("D20",))
def q_signal_precision(spark, sf):
    """Per flag: holders, share with positive forward value, mean."""
    return D.signal_precision(gold(spark, sf), FLAGS)


@register("dip_signal", sql=G + """
SELECT COUNT(*) FILTER (WHERE drawdown_pct < -0.15 AND signal_score >= 1) AS deep_flagged_count,
       COALESCE(AVG(CASE WHEN drawdown_pct < -0.15 AND signal_score >= 1 THEN fwd_60d_median END), 0.0) AS avg_fwd
FROM gold""", floats=("avg_fwd",), ops=("D21",))
def q_dip_signal(spark, sf):
    """Flagged rows in deep drawdown and their mean forward value."""
    return D.dip_signal(gold(spark, sf))


@register("activation_report", sql=G + """
SELECT COUNT(*) FILTER (WHERE signal_1) AS n_signal_1, COUNT(*) FILTER (WHERE signal_2) AS n_signal_2,
       COUNT(*) FILTER (WHERE signal_3) AS n_signal_3, COUNT(*) FILTER (WHERE signal_4) AS n_signal_4,
       COUNT(*) FILTER (WHERE signal_5) AS n_signal_5, COUNT(*) FILTER (WHERE top_tier) AS n_top_tier,
       AVG(buy_pct) AS avg_buy, AVG(call_pct) AS avg_call, AVG(put_pct) AS avg_put,
       AVG(short_pct) AS avg_short
FROM gold""", floats=("avg_buy", "avg_call", "avg_put", "avg_short"), ops=("D29",))
def q_activation(spark, sf):
    """Activation count per signal and mean direction bias."""
    g = gold(spark, sf)
    return g.agg(*[F.count_if(F.col(f)).alias(f"n_{f}") for f in FLAGS],
                 F.count_if(F.col("top_tier")).alias("n_top_tier"),
                 F.avg("buy_pct").alias("avg_buy"), F.avg("call_pct").alias("avg_call"),
                 F.avg("put_pct").alias("avg_put"), F.avg("short_pct").alias("avg_short"))


@register("monthly_activity", sql=G + f"""
SELECT CAST(date_trunc('month', dt) AS DATE) AS month,
       {', '.join(f'CAST(SUM(CAST({f} AS INTEGER)) AS BIGINT) AS {f}' for f in FLAGS)},
       COUNT(*) FILTER (WHERE top_tier) AS top_tier_events
FROM gold GROUP BY 1""", ops=("D23", "L15"))
def q_monthly(spark, sf):
    """Monthly flag sums and top-tier events."""
    return D.monthly_activity(gold(spark, sf), FLAGS)


@register("mean_daily_counts", sql=G + """
, days AS (SELECT DISTINCT dt FROM gold),
grid AS (SELECT dt, CAST(s AS INTEGER) AS signal_score FROM days, range(0, 6) r(s)),
per AS (SELECT dt, signal_score, COUNT(*) AS n FROM gold GROUP BY dt, signal_score)
SELECT grid.signal_score, AVG(COALESCE(per.n, 0)) AS avg_per_day
FROM grid LEFT JOIN per ON grid.dt = per.dt AND grid.signal_score = per.signal_score
GROUP BY grid.signal_score""", floats=("avg_per_day",), ops=("D32",))
def q_mean_daily(spark, sf):
    """Mean rows per day for each score, zero-filled."""
    return D.mean_daily_counts(gold(spark, sf))


@register("top_signals", sql=G + """
SELECT ticker, dt, signal_score, rarity_percentile, drawdown_pct FROM gold
ORDER BY signal_score DESC, rarity_percentile DESC, dt DESC, ticker LIMIT 20""",
          floats=("rarity_percentile", "drawdown_pct"), ops=("H1",))
def q_top_signals(spark, sf):
    """Top 20 rows by score (unique tiebreak)."""
    g = gold(spark, sf).select("ticker", "dt", "signal_score", "rarity_percentile", "drawdown_pct")
    return H.top_n(g, [F.col("signal_score").desc(), F.col("rarity_percentile").desc(),
                       F.col("dt").desc(), F.col("ticker")], 20)


@register("top3_per_sector", sql=G + """
SELECT sector, ticker, dt, signal_score, rnk FROM (
  SELECT sector, ticker, dt, signal_score,
         ROW_NUMBER() OVER (PARTITION BY sector ORDER BY signal_score DESC, drawdown_percentile DESC,
                            dt DESC, ticker) AS rnk
  FROM gold WHERE sector IS NOT NULL) WHERE rnk <= 3""", ops=("H2",))
def q_top3(spark, sf):
    """Top 3 rows per sector."""
    g = gold(spark, sf).filter(F.col("sector").isNotNull())
    out = H.top_k_per_group(g, "sector", [F.col("signal_score").desc(), F.col("drawdown_percentile").desc(),
                                          F.col("dt").desc(), F.col("ticker")], 3, out="rnk")
    return out.select("sector", "ticker", "dt", "signal_score", "rnk")


@register("coverage", sql=with_ctes(BARS) + """
SELECT ticker, COUNT(*) AS rows, MIN(dt) AS first_date, MAX(dt) AS last_date, AVG(volume) AS avg_volume
FROM bars GROUP BY ticker""", floats=("avg_volume",), ops=("D6",))
def q_coverage(spark, sf):
    """Rows, first/last date and mean volume per instrument."""
    return D.coverage(FX.bars_table(spark, sf))


@register("return_stats", sql=with_ctes(BARS, SILVER) + """
SELECT ticker, COUNT(daily_return) AS n, AVG(daily_return) AS mean_return,
       STDDEV_SAMP(daily_return) AS std_return,
       CASE WHEN COUNT(daily_return) > 2 THEN SKEWNESS(daily_return) END AS skew,
       AVG(daily_return) * 252.0 AS ann_return, STDDEV_SAMP(daily_return) * sqrt(252.0) AS ann_vol,
       AVG(daily_return) * 252.0 / NULLIF(STDDEV_SAMP(daily_return) * sqrt(252.0), 0) AS sharpe
FROM silver GROUP BY ticker""",
          floats=("mean_return", "std_return", "skew", "ann_return", "ann_vol", "sharpe"), digits=4, ops=("D7",))
def q_return_stats(spark, sf):
    """Per-instrument mean, std, adjusted skew, annualised return/vol, Sharpe."""
    return D.return_stats(with_returns(FX.bars_table(spark, sf)))


@register("sector_means", sql=with_ctes(BARS) + """
SELECT sector, AVG(volume) AS avg_volume, AVG(close) AS avg_close FROM bars GROUP BY sector""",
          floats=("avg_volume", "avg_close"), ops=("D24",))
def q_sector_means(spark, sf):
    """Mean volume and close per sector."""
    return D.sector_means(FX.bars_table(spark, sf), ["volume", "close"])


@register("profile", sql=with_ctes(BARS) + """
SELECT COUNT(*) AS rows, COUNT(DISTINCT ticker) AS distinct_keys, MIN(dt) AS min_date, MAX(dt) AS max_date,
       COUNT(*) FILTER (WHERE close IS NULL) AS null_close, COUNT(*) FILTER (WHERE volume IS NULL) AS null_volume,
       COUNT(*) FILTER (WHERE sector IS NULL) AS null_sector
FROM bars""", ops=("D1",))
def q_profile(spark, sf):
    """Row, key, date-range and null counts in one pass."""
    return D.profile(FX.bars_table(spark, sf), "ticker", "dt", ["close", "volume", "sector"])


@register("duplicate_keys", sql="""
SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING COUNT(*) > 1""", ops=("D14",))
def q_duplicates(spark, sf):
    """(part, supplier) keys that occur more than once among the trades."""
    return D.duplicate_keys(load(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@register("first_date_with", sql=with_ctes(BARS) + """
SELECT MIN(dt) AS first_date FROM (
  SELECT dt FROM bars GROUP BY dt HAVING COUNT(DISTINCT ticker) >= 10)""", ops=("D15",))
def q_first_date(spark, sf):
    """First date with at least 10 instruments."""
    return D.first_date_with(FX.bars_table(spark, sf), 10)


@register("modal_score", sql=G + """
SELECT signal_score AS mode FROM (SELECT signal_score, COUNT(*) AS n FROM gold GROUP BY signal_score)
ORDER BY n DESC, signal_score LIMIT 1""", ops=("D11",))
def q_modal(spark, sf):
    """Most frequent score (ties to the smallest)."""
    return D.modal_value(gold(spark, sf), "signal_score")


@register("sector_summary", sql=G + """
SELECT r.r_name AS sector, COUNT(g.ticker) AS n, AVG(g.signal_score) AS avg_score,
       COUNT(*) FILTER (WHERE g.signal_score >= 1) AS flagged, CAST(COALESCE(SUM(g.density), 0) AS BIGINT) AS density
FROM region r LEFT JOIN gold g ON g.sector = r.r_name GROUP BY r.r_name""",
          floats=("avg_score",), ops=("D16",))
def q_sector_summary(spark, sf):
    """Per-sector roll-up incl. sectors without rows (right join to the list)."""
    from ..sources import load
    sectors = load(spark, sf, "region").select(F.col("r_name").alias("sector"))
    g = gold(spark, sf)
    j = sectors.join(g, "sector", "left")
    return j.groupBy("sector").agg(F.count("ticker").alias("n"), F.avg("signal_score").alias("avg_score"),
                                   F.count_if(F.col("signal_score") >= 1).alias("flagged"),
                                   F.coalesce(F.sum("density"), F.lit(0)).cast("long").alias("density"))


@register("latest_snapshot", sql=G + """
SELECT ticker, dt, signal_score FROM gold WHERE dt = (SELECT MAX(dt) FROM gold)""", ops=("B8", "C14"))
def q_latest(spark, sf):
    """Rows of the latest date."""
    return H.latest_snapshot(gold(spark, sf)).select("ticker", "dt", "signal_score")


@register("snapshot_offset", sql=with_ctes(BARS) + """
SELECT ticker, dt, close FROM bars
WHERE dt = (SELECT MIN(dt) FROM bars WHERE dt >= (SELECT MAX(dt) FROM bars) - INTERVAL 90 DAY)""",
          floats=("close",), ops=("B9",))
def q_snapshot_offset(spark, sf):
    """Rows of the first date at or after max date - 90 days."""
    return H.snapshot_at_offset(FX.bars_table(spark, sf)).select("ticker", "dt", "close")


@register("nth_date", sql=with_ctes(BARS) + """
SELECT ticker, dt, close FROM bars WHERE dt = (SELECT dt FROM (SELECT DISTINCT dt FROM bars) ORDER BY dt OFFSET 100 LIMIT 1)""",
          floats=("close",), ops=("H6",))
def q_nth_date(spark, sf):
    """Rows of the 101st distinct date."""
    return H.nth_date(FX.bars_table(spark, sf), 100).select("ticker", "dt", "close")


@register("lookup_latest", sql=G + """
SELECT ticker, dt, close, signal_score FROM gold WHERE ticker = 'MKT' ORDER BY dt DESC LIMIT 1""",
          floats=("close",), ops=("B15",))
def q_lookup(spark, sf):
    """Point lookup: the latest row of one instrument."""
    return H.lookup(gold(spark, sf), "ticker", "MKT").select("ticker", "dt", "close", "signal_score")
