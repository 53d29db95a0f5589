"""Derived inputs: the given TPC-H-style tables re-aimed as market data.

``bars`` is the daily price bar table every feature starts from
(ticker = nation of the supplier, sector = region, one bar per ship date,
price = extendedprice / quantity). ``MKT`` is the benchmark: the bar of
all trades of the day, sector null.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import load, storage

BENCHMARK = "MKT"

# So many suppliers (two numbers each, some 16 MB) are broadcast at most.
BROADCAST_SUPPLIERS = 500_000

# Fixed values (test fixture, from FIXTURES.md): keyword dictionary for the
# invented prose, sentiment lexicon, and the three scenario periods.
KEYWORDS = {"AND": ["and"], "THE": ["the"], "FOR": ["for"], "WITH": ["with"], "FROM": ["from"]}
NEGATIVE_WORDS = ["for", "from", "by"]
POSITIVE_WORDS = ["the", "with", "this"]
SCENARIOS = [
    (1, "scenario_1996q1", "1996-01-01", "1996-03-31"),
    (2, "scenario_1998q3", "1998-06-01", "1998-08-31"),
    (3, "scenario_2000h1", "2000-01-01", "2000-06-30"),
]


def bars(spark: SparkSession, sf_dir: str, benchmark: str = BENCHMARK) -> DataFrame:
    """Daily OHLCV bars per ticker plus the benchmark instrument.

    Open/close are the price of the first/last trade of the day by the
    unique five-column trade key. No sort of all trades gives them: a first
    pass aggregates each (nation, day) by hash (every buffer has a fixed
    width), with the smallest and largest order key; a second pass keeps the
    trades of those orders, and only these are compared by the whole key.
    A hot (nation, day) is combined map-side, never whole in one task.
    Instrument bars and the benchmark bar are one ``rollup`` over the
    (nation, day) rows. Dimensions: nation/region are fixed 25/5-row tables
    (broadcast), the end orders of the (nation, day) rows are bounded by the
    calendar (broadcast). Supplier grows with the data: up to
    ``BROADCAST_SUPPLIERS`` rows are broadcast, more are joined by hash after
    a shuffle, so that the trades are never sorted for this join.
    """
    from ..session import layer_table
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    trades = load(spark, sf_dir, "lineitem").select(
        *key, F.to_date("l_shipdate").alias("dt"), F.try_divide("l_extendedprice", "l_quantity").alias("px"),
        F.col("l_quantity").alias("qty"))
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions.
    geo = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
           .select("n_nationkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")))
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"))
    sup = sup.join(F.broadcast(geo), F.col("nk") == F.col("n_nationkey"), "left_semi")
    sup = sup.hint("broadcast" if sup.count() <= BROADCAST_SUPPLIERS else "shuffle_hash")

    def by_supplier(t):
        return t.join(sup, t.l_suppkey == sup.s_suppkey).drop("s_suppkey")

    # A missing order key comes before all others, as in the trade key.
    first = F.when(F.count("l_orderkey") == F.count(F.lit(1)), F.min("l_orderkey"))
    days = layer_table(by_supplier(trades).groupBy("nk", "dt").agg(
        first.alias("lo"), F.max("l_orderkey").alias("hi"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.sum("qty").alias("vol")), "bar-days")
    orders = days.select(F.col("dt").alias("__dt"), F.explode(F.array("lo", "hi")).alias("__o")).distinct()
    ends = trades.join(F.broadcast(orders), F.col("dt").eqNullSafe(F.col("__dt"))
                       & F.col("l_orderkey").eqNullSafe(F.col("__o")), "left_semi")
    days = days.withColumnsRenamed({"nk": "__nk", "dt": "__dt"})
    ends = by_supplier(ends).join(days, (F.col("nk") == F.col("__nk")) & F.col("dt").eqNullSafe(F.col("__dt"))
                                  & (F.col("l_orderkey").eqNullSafe(F.col("lo")) | F.col("l_orderkey").eqNullSafe(F.col("hi"))))
    ends = ends.withColumn("k", F.struct(*key))
    by_nation = ends.groupBy("nk", "dt").agg(
        *[F.max(c).alias(c) for c in ("high", "low", "vol")],  # the same in all rows of a group
        F.min("k").alias("k0"), F.min_by("px", "k").alias("open"), F.max("k").alias("k1"), F.max_by("px", "k").alias("close"))
    # One aggregation for both levels: rollup(dt, ticker) gives the
    # (dt, ticker) bars and the (dt) market bar; the grand-total level is
    # dropped.
    g = by_nation.join(F.broadcast(geo), F.col("nk") == F.col("n_nationkey")).rollup("dt", "ticker").agg(
        F.grouping_id().alias("__g"), F.max("sector").alias("sector"),
        F.min_by("open", "k0").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "k1").alias("close"), F.sum("vol").alias("vol"))
    g = g.filter(F.col("__g") < 3)
    market = F.col("__g") == 1
    return g.select(F.when(market, F.lit(benchmark)).otherwise(F.col("ticker")).alias("ticker"),
                    F.when(market, F.lit(None).cast("string")).otherwise(F.col("sector")).alias("sector"),
                    "dt", "open", "high", "low", "close", F.col("vol").cast("long").alias("volume"))


def bars_table(spark: SparkSession, sf_dir: str, benchmark: str = BENCHMARK) -> DataFrame:
    """``bars`` written once into the shared checkpoint folder.

    Feature plans read the bar table on several branches (instruments,
    benchmark, size rank); a written Parquet table turns those into pruned
    scans of one small table (instruments x dates) instead of repeated
    aggregations of the trade table, and cuts the lineage so a lost executor
    rereads it instead of the raw trades.
    """
    from ..session import layer_table
    key = ("bars", spark.sparkContext.applicationId, sf_dir, benchmark, stamp(spark, sf_dir))
    if key not in _TABLES:
        _TABLES[key] = layer_table(bars(spark, sf_dir, benchmark), "bars")
    return _TABLES[key]


# Materialised derived tables of this application (like the bronze/silver
# tables of a medallion layout): computed once per input version, then
# scanned by every plan that needs them.
_TABLES: dict = {}


def stamp(spark: SparkSession, sf_dir: str, names=("lineitem", "supplier", "nation", "region")):
    """Version of the inputs that a derived table is built from."""
    return tuple(storage.stamp(spark, f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News articles from ``documents``: whole text as the title."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.col("doc_id"),
        F.col("text").alias("title"),
        F.col("source"), F.col("lang").alias("language"),
        F.date_add(F.lit(_dt.date(2024, 1, 1)), (F.col("doc_id") % 30).cast("int")).alias("published_date"),
        ((F.col("n_chars") % 201 - 100) / F.lit(10.0)).cast("double").alias("tone"),
        F.col("lang").alias("scenario"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social posts from user turns of ``conversations``."""
    c = load(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id"), F.col("turn"),
        F.col("text").alias("title"), F.col("text").alias("selftext"),
        F.length("text").cast("long").alias("score"),
        (F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("conv_id") * 3600).cast("double").alias("created_utc"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro series from ``orders``: one series per order priority."""
    o = load(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    g = o.groupBy(F.col("o_orderpriority").alias("series_id"),
                  F.to_date("o_orderdate").alias("observation_date")).agg(
        F.max("o_totalprice").alias("v"))
    return g.select("series_id", "observation_date",
                    F.when(F.dayofmonth("observation_date") != 13, F.col("v")).alias("value"))


# The benchmark of the fixture gains some 50 in 20 rows (prices of unlike
# parts): levels between which all three regimes occur.
REGIME_LOW, REGIME_HIGH = 30.0, 60.0


def regimes(silver: DataFrame) -> DataFrame:
    """Regime of each date of the fixture's benchmark."""
    from ..operators.decide import benchmark_regimes
    return benchmark_regimes(silver, BENCHMARK, REGIME_LOW, REGIME_HIGH)


REGIME_SQL = f"CASE WHEN rolling_return_20d > {REGIME_HIGH} THEN 'Bull' WHEN rolling_return_20d < {REGIME_LOW} THEN 'Bear'"


def instrument_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, dt, tone) of every document: doc_id deals it to a nation and to
    a date of a scenario period, its length gives the tone from -100 to 100."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    d = load(spark, sf_dir, "documents").filter("doc_id is not null and n_chars is not null").select(
        ((F.col("doc_id") * 7 + F.floor(F.col("doc_id") / 25)) % 25).alias("k"), (F.col("doc_id") % 3 + 1).cast("int").alias("scenario_id"),
        F.floor(F.col("doc_id") / 3).cast("long").alias("n"), (F.col("n_chars") % 201 - 100).alias("tone"))
    s = F.broadcast(scenarios(spark))  # three rows
    d = d.join(s, "scenario_id").withColumn("dt", F.date_add("start_date", (F.col("n") % (F.datediff("end_date", "start_date") + 1)).cast("int")))
    d = d.join(F.broadcast(nation), d.k == nation.n_nationkey)  # 25 rows
    return d.select("ticker", "dt", "tone")


def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean sentiment in [-1, 1] by instrument and date."""
    d = instrument_news(spark, sf_dir)
    return d.groupBy("ticker", "dt").agg((F.sum("tone") / F.lit(100.0) / F.count(F.lit(1))).alias("sentiment_mean"))


SCENARIO_SQL = ("scen AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', DATE '{a}', DATE '{b}')" for i, n, a, b in SCENARIOS)
                + ") AS t(scenario_id, scenario_name, start_date, end_date))")
INSTRUMENT_NEWS_SQL = """
inews AS (SELECT n_name AS sticker, sdt, tone FROM (
  SELECT (doc_id * 7 + doc_id // 25) % 25 AS k, s.start_date + CAST((doc_id // 3) % (s.end_date - s.start_date + 1) AS INTEGER) AS sdt,
         n_chars % 201 - 100 AS tone
  FROM documents JOIN scen s ON s.scenario_id = doc_id % 3 + 1 WHERE n_chars IS NOT NULL)
  JOIN nation ON k = n_nationkey)"""
SENTIMENT_SQL = INSTRUMENT_NEWS_SQL + """,
sent AS (SELECT sticker, sdt, SUM(tone) / CAST(100 AS DOUBLE) / COUNT(*) AS sentiment_mean FROM inews GROUP BY sticker, sdt)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument metadata from ``part`` grouped by brand."""
    p = load(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("ticker")).agg(
        F.min("p_type").alias("sector"), F.max("p_retailprice").alias("market_cap"))


def scenarios(spark: SparkSession) -> DataFrame:
    """The three named scenario periods (fixed parameter table)."""
    schema = T.StructType([
        T.StructField("scenario_id", T.IntegerType()), T.StructField("scenario_name", T.StringType()),
        T.StructField("start_date", T.StringType()), T.StructField("end_date", T.StringType())])
    return spark.createDataFrame(SCENARIOS, schema).select(
        "scenario_id", "scenario_name", F.to_date("start_date").alias("start_date"),
        F.to_date("end_date").alias("end_date"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading agents: every customer."""
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("agent_id"), F.col("c_name").alias("agent_name"),
                    F.col("c_mktsegment").alias("style"), F.col("c_acctbal").alias("capital"))
