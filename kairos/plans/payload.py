"""Nested JSON documents.

Documents are built with ``struct`` / ``collect_list`` / ``to_json`` on the
executors and written with ``write.text`` / ``partitionBy``; nothing passes
through the driver. No single group holds the whole universe: the snapshot
is one document per (snapshot date, sector), the graph one document per
node (its adjacency list), the scenario one document per scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import finite_or
from ..operators.ranking import latest_per_key


def _r(c, d):
    return F.round(finite_or(c, 0.0), d)


def stock_struct(df: DataFrame):
    """One stock entry (rounded fields, nested tickets/bias/dimensions)."""
    return F.struct(
        F.col("ticker"), F.coalesce("sector", F.lit("Unknown")).alias("sector"), _r("close", 4).alias("close"),
        _r("daily_return", 6).alias("daily_return"), _r("drawdown_pct", 4).alias("drawdown_current"),
        _r("volume_percentile", 4).alias("volume_percentile"), _r("vol_percentile", 4).alias("volatility_percentile"),
        F.col("signal_score"), F.col("top_tier"), _r("rarity_percentile", 4).alias("rarity_percentile"),
        F.struct(*[F.col(f"signal_{i}").alias(f"signal_{i}") for i in range(1, 6)]).alias("signals"),
        F.struct(_r("buy_pct", 2).alias("buy"), _r("call_pct", 2).alias("call"), _r("put_pct", 2).alias("put"),
                 _r("short_pct", 2).alias("short")).alias("direction_bias"),
        F.struct(_r("fwd_60d_p5", 4).alias("p5"), _r("fwd_60d_p25", 4).alias("p25"),
                 _r("fwd_60d_median", 4).alias("median"), _r("fwd_60d_p75", 4).alias("p75"),
                 _r("fwd_60d_p95", 4).alias("p95"), _r("fwd_60d_skew", 4).alias("skew")).alias("forward_distribution"),
        F.struct(_r("width", 2).alias("width"), _r("height", 2).alias("height"), _r("depth", 2).alias("depth"),
                 _r("glow", 2).alias("glow")).alias("dimensions"),
        F.col("density"), _r("speed", 2).alias("speed"),
        F.struct(_r("rsi_14", 2).alias("rsi_14"), _r("macd_histogram", 4).alias("macd_histogram"),
                 _r("bb_pct_b", 4).alias("bb_pct_b"), _r("zscore_20d", 4).alias("zscore_20d"),
                 _r("realized_vol_20d", 4).alias("realized_vol_20d")).alias("technicals"))


def build_snapshot_payload(gold: DataFrame) -> DataFrame:
    """Each instrument's latest row, grouped into one JSON document per
    sector (stocks sorted by ticker) with per-sector meta."""
    last = latest_per_key(gold)
    g = last.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(
        F.sort_array(F.collect_list(stock_struct(last))).alias("stocks"),
        F.max("dt").alias("snapshot_date"), F.count(F.lit(1)).alias("stock_count"),
        F.count_if(F.col("top_tier")).alias("top_tier_count"), F.avg("signal_score").alias("avg_score"))
    doc = F.struct("sector", "snapshot_date", "stock_count", "top_tier_count",
                   F.round("avg_score", 4).alias("avg_score"), "stocks")
    return g.select("sector", F.to_json(doc).alias("json"), F.to_json(doc, {"pretty": "true"}).alias("json_pretty"))


def build_graph_payload(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One JSON document per node: sector, community and its edges."""
    from ..operators.graph import both_directions
    adj = both_directions(edges).groupBy(F.col("src").alias("ticker")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("dst").alias("target"), F.round("weight", 4).alias("weight"),
                                             "edge_type"))).alias("edges"))
    n = nodes.join(adj, "ticker", "left")
    if communities is not None:
        n = n.join(communities, "ticker", "left")
    cols = [c for c in ("ticker", "sector", "community", "community_size", "edges") if c in n.columns]
    return n.select("ticker", F.to_json(F.struct(*cols)).alias("json"))


def build_scenario_payload(flow_agg: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """One document per scenario: dates (sorted) each with its regime
    and its instruments ordered by agents (desc, then ticker)."""
    f = flow_agg
    if regimes is not None:
        f = f.join(regimes.select("dt", "regime_label"), "dt", "left")
    else:
        f = f.withColumn("regime_label", F.lit("Neutral"))
    stock = F.struct((-F.col("agents")).alias("__o"), F.col("ticker"), F.col("agents"), F.col("buy_count"),
                     F.col("call_count"), F.col("put_count"), F.col("short_count"),
                     F.round("bullish_ratio", 4).alias("bullish_ratio"), F.col("net_flow"))
    per_day = f.groupBy("scenario_id", "dt").agg(F.first("regime_label", ignorenulls=True).alias("regime"),
                                                 F.sort_array(F.collect_list(stock)).alias("__s"))
    per_day = per_day.withColumn("stocks", F.transform("__s", lambda s: s.dropFields("__o"))).drop("__s")
    doc = per_day.groupBy("scenario_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("dt").cast("string").alias("date"), "regime", "stocks"))).alias("dates"))
    return doc.select("scenario_id", F.to_json(F.struct("scenario_id", "dates")).alias("json"))


def build_topic_metadata(topics: DataFrame, cls="topic_id") -> DataFrame:
    """model/topic metadata document (topics are few: one row)."""
    t = topics.select(F.struct(cls, "topic_label", "keywords").alias("t"))
    return t.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("topic_count"),
                                    F.sort_array(F.collect_list("t")).alias("topics"))).alias("json"))


def write_documents(docs: DataFrame, path: str, key: str) -> None:
    """Write one text file per document key (``partitionBy``)."""
    docs.select(key, "json").write.mode("overwrite").partitionBy(key).text(path)
