"""Registered queries: sources read back, keyword dictionaries, column and
length rules (A1-A3, A7, A8, B5, B11, C2, D25, L1, L4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.keywords import match_dictionary
from ..operators import ml as N
from ..operators.joins import SECTOR_MAP, VALID_SECTORS, normalise_sector
from ..registry import register
from ..session import checkpoint_dir
from ..sources import files, load, tables
from . import fixtures as FX
from .catalog_text import ARTICLES, _kw_sql
from .silver import silver_table
from .sqltext import BARS, with_ctes

# The bars with events: dividends on the 15th of a month, splits on the
# first of July, as columns of the CSV form.
EVENTS = """
ev AS (SELECT ticker, dt, open, high, low, close, volume, CASE WHEN day(dt) = 15 THEN close * 0.01 ELSE CAST(0 AS DOUBLE) END AS dividends,
              CASE WHEN day(dt) = 1 AND month(dt) = 7 THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS stock_splits FROM bars)
"""


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/sources/{name}-{uuid.uuid4().hex}"


def _bars_csv(spark, sf):
    """The bar table written as header CSV files and read by the CSV source."""
    b = FX.bars_table(spark, sf)
    day = F.dayofmonth("dt")
    out = b.select(F.col("dt").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                   F.col("close").alias("Close"), F.col("volume").alias("Volume"), F.when(day == 15, F.col("close") * 0.01).otherwise(0.0).alias("Dividends"),
                   F.when((day == 1) & (F.month("dt") == 7), 2.0).otherwise(0.0).alias("Stock Splits"), F.col("ticker").alias("Company"))
    path = _folder(spark, "bars-csv")
    out.write.option("header", True).csv(path)
    return files.read_bars_csv(spark, path)


@register("bars_csv", sql=with_ctes(BARS, EVENTS) + "SELECT * FROM ev", floats=("open", "high", "low", "close", "dividends", "stock_splits"),
          ops=("A1", "A2"))
def q_bars_csv(spark, sf):
    """Bars through the CSV format and its reader, renamed columns."""
    return _bars_csv(spark, sf).select("ticker", "dt", "open", "high", "low", "close", "volume", "dividends", "stock_splits")


@register("corporate_events", sql=with_ctes(BARS, EVENTS) + """
SELECT ticker, COUNT(*) FILTER (WHERE stock_splits <> 0) AS split_events, COUNT(*) FILTER (WHERE dividends <> 0) AS dividend_events,
       MAX(stock_splits) AS largest_split, SUM(dividends) AS dividends_paid
FROM ev WHERE stock_splits <> 0 OR dividends <> 0 GROUP BY ticker""", floats=("largest_split", "dividends_paid"), ops=("D25",))
def q_corporate_events(spark, sf):
    """Split and dividend events (non-zero) by instrument."""
    e = _bars_csv(spark, sf).filter((F.col("stock_splits") != 0) | (F.col("dividends") != 0))
    return e.groupBy("ticker").agg(F.count_if(F.col("stock_splits") != 0).alias("split_events"), F.count_if(F.col("dividends") != 0).alias("dividend_events"),
                                   F.max("stock_splits").alias("largest_split"), F.sum("dividends").alias("dividends_paid"))


@register("lenient_prices", sql=with_ctes(BARS) + """
SELECT ticker, CAST(dt AS VARCHAR) AS dt, close, volume FROM bars WHERE day(dt) % 7 <> 0 AND day(dt) % 5 <> 0""", floats=("close",), ops=("A3",))
def q_lenient_prices(spark, sf):
    """Prices with unreadable fields in the file: those rows are left out."""
    b = FX.bars_table(spark, sf)
    day = F.dayofmonth("dt")
    path = _folder(spark, "prices-csv")
    b.select("ticker", F.col("dt").cast("string").alias("date"), F.when(day % 7 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("close"),
             F.when(day % 5 == 0, "").otherwise(F.col("volume").cast("string")).alias("volume")).write.option("header", True).csv(path)
    return files.read_prices_lenient(spark, path)


@register("first_table", sql="SELECT COUNT(*) AS rows FROM region", ops=("A8",))
def q_first_table(spark, sf):
    """The first existing one of several tables."""
    return tables.read_first(spark, f"{sf.rstrip('/')}/no_such_table.parquet", f"{sf.rstrip('/')}/region.parquet").agg(F.count(F.lit(1)).alias("rows"))


@register("long_titles", sql=with_ctes(ARTICLES) + """
SELECT url, length(trim(title)) AS title_length FROM articles WHERE title IS NOT NULL AND length(trim(title)) > 10""", ops=("B5",))
def q_long_titles(spark, sf):
    """Articles whose trimmed title has more than 10 characters."""
    a = TX.filter_min_text(FX.articles(spark, sf), "title", 10)
    return a.select("url", F.length(F.trim("title")).alias("title_length"))


@register("keyword_automaton", sql=with_ctes(ARTICLES) + f"SELECT url, {_kw_sql('title')} AS matched_tickers FROM articles", ops=("L1", "U3"))
def q_keyword_automaton(spark, sf):
    """Instruments mentioned in each article, by one automaton for the dictionary."""
    return FX.articles(spark, sf).select("url", match_dictionary(spark, F.col("title"), FX.KEYWORDS).alias("matched_tickers"))


# Columns that look ahead, and prices that the features already hold.
NOT_FEATURES = ("open", "high", "low", "close", "volume", *[f"fwd_return_{n}d" for n in (5, 20, 60)])


@register("feature_columns", ops=("B11",))
def q_feature_columns(spark, sf):
    """Each numeric feature column of the feature table (by schema type, less
    the excluded ones) with its rows, nulls and mean."""
    s = silver_table(spark, sf)
    cols = [c for c in N.numeric_features(s, NOT_FEATURES) if not c.startswith("fwd_")]
    one = s.agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("values"), F.count_if(F.col(c).isNull()).alias("nulls"),
                           F.avg(F.col(c).cast("double")).alias("mean")).alias(f"c{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def _sector_case():
    return "CASE sector " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SECTOR_MAP.items()) + " ELSE sector END"


_NAMES = list(dict.fromkeys([*SECTOR_MAP, *VALID_SECTORS, "Unknown Sector"]))


@register("sector_names", sql=f"""
WITH s AS (SELECT p_partkey, ([{", ".join("'" + n + "'" for n in _NAMES)}])[1 + p_partkey % {len(_NAMES)}] AS sector FROM part)
SELECT p_partkey, {_sector_case()} AS sector FROM s
WHERE {_sector_case()} IN ({", ".join("'" + v + "'" for v in VALID_SECTORS)})""", ops=("C2",))
def q_sector_names(spark, sf):
    """Sector names dealt to the parts, mapped to display names; rows of no
    valid sector go."""
    p = load(spark, sf, "part").select("p_partkey", F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES)).cast("int")).alias("sector"))
    return normalise_sector(p)


@register("parsed_times", sql="""
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
s AS (SELECT o_orderkey, d, CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y%m%d') || 'T101112' WHEN 1 THEN strftime(d, '%Y-%m-%d') || ' 10:11:12'
                                WHEN 2 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%d/%m/%Y') END AS raw FROM t)
SELECT o_orderkey, raw, CASE o_orderkey % 4 WHEN 2 THEN strftime(d, '%Y-%m-%d') || ' 00:00:00' WHEN 3 THEN NULL
                             ELSE strftime(d, '%Y-%m-%d') || ' 10:11:12' END AS parsed FROM s""", ops=("L4",))
def q_parsed_times(spark, sf):
    """Order dates written in four formats; the last one can't be read."""
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.date_format(d, "yyyyMMdd"), F.lit("T101112"))).when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:11:12"))) \
        .when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    o = load(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return o.withColumn("parsed", F.date_format(TX.parse_ts("raw"), "yyyy-MM-dd HH:mm:ss"))
