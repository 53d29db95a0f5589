"""File sources: CSV bars, lenient price files, metadata, macro JSON,
articles, posts and broker CSV (A1-A4, A9-A11, A13)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS_CSV_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()), T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()), T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()), T.StructField("Volume", T.LongType()),
    T.StructField("Dividends", T.DoubleType()), T.StructField("Stock Splits", T.DoubleType()),
    T.StructField("Company", T.StringType())])


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1/A2: daily bar CSV with header and a fixed schema; renamed on read."""
    df = spark.read.schema(BARS_CSV_SCHEMA).option("header", True).csv(path)
    return df.withColumnsRenamed({"Company": "ticker", "Stock Splits": "stock_splits", "Date": "dt",
                                  "Open": "open", "High": "high", "Low": "low", "Close": "close",
                                  "Volume": "volume", "Dividends": "dividends"})


def read_prices_lenient(spark: SparkSession, path: str) -> DataFrame:
    """A3: long-history prices; rows whose close or volume do not parse are
    skipped (every column read as text, then ``try_cast``)."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.select(F.col("ticker"), F.col("date").alias("dt"),
                     F.expr("try_cast(close AS DOUBLE)").alias("close"),
                     F.expr("try_cast(try_cast(volume AS DOUBLE) AS BIGINT)").alias("volume"))
    return out.filter(F.col("close").isNotNull() & F.col("volume").isNotNull())


def clean_metadata(df: DataFrame) -> DataFrame:
    """A4: trim text fields; empty or bad market cap -> 0."""
    return df.select(*[F.trim(F.col(c)).alias(c) for c in ("ticker", "name", "sector", "industry", "country")
                       if c in df.columns],
                     F.coalesce(F.expr("try_cast(trim(market_cap) AS DOUBLE)"), F.lit(0.0)).alias("market_cap"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A4: metadata CSV scan."""
    return clean_metadata(spark.read.option("header", True).csv(path))


MACRO_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("observations", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()), T.StructField("value", T.StringType())])))])


def parse_observations(df: DataFrame) -> DataFrame:
    """Explode ``observations[]``; "." / "" / non-numeric -> null."""
    ex = df.select("series_id", F.explode("observations").alias("o"))
    return ex.select("series_id", F.to_date(F.col("o.date")).alias("observation_date"),
                     F.expr("try_cast(nullif(nullif(trim(o.value), '.'), '') AS DOUBLE)").alias("value"))


def read_macro_json(spark: SparkSession, path: str) -> DataFrame:
    """Macro series JSON files (one document per series)."""
    return parse_observations(spark.read.schema(MACRO_SCHEMA).option("multiLine", True).json(path))


def ingest_articles(df: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """A10: typed article rows with defaults, scenario tags and ingest time.

    Expects url, title, source, published (timestamp or text), language,
    tone, scenario. Missing text -> "", tone -> 0.0; ``scenarios`` (id,
    name, start, end) adds the scenario period by name.
    """
    out = df.select(
        "url", F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("published_date"), F.coalesce(F.col("language"), F.lit("")).alias("language"),
        F.coalesce(F.col("tone").cast("double"), F.lit(0.0)).alias("tone"), "scenario")
    out = out.withColumn("ingested_at", F.current_timestamp())
    if scenarios is not None:
        out = out.join(F.broadcast(scenarios.select(F.col("scenario_name").alias("scenario"), "start_date",
                                                     "end_date")), "scenario", "left")
    return out


def dedupe_by(df: DataFrame, k, order) -> DataFrame:
    """K1/K2: keep the first row per key by a stable (ascending) order.

    An aggregation, not a per-key window: ``min_by(row, order)`` combines
    map-side, so a key with a huge group of copies (one text copied a
    million times) never lands whole in one task.
    """
    k = [k] if isinstance(k, str) else list(k)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in k]
    g = df.groupBy(*k).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return g.select(*k, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def ingest_posts(df: DataFrame, start: str, end: str, preview=500) -> DataFrame:
    """Posts in [start, end] (UTC), deduped by id, whole title and body, a
    preview of the body's first ``preview`` characters, null author ->
    "[deleted]"."""
    ts = F.timestamp_seconds(F.col("created_utc").cast("long"))
    df = df.withColumn("created_ts", ts).filter(
        (F.col("created_ts") >= F.to_timestamp(F.lit(start))) & (F.col("created_ts") <= F.to_timestamp(F.lit(end))))
    df = dedupe_by(df, "id", ["created_utc", "title"])
    author = F.col("author") if "author" in df.columns else F.lit(None).cast("string")
    return df.select(F.col("id").alias("post_id"), "title", F.coalesce("selftext", F.lit("")).alias("body"),
                     F.substring(F.coalesce("selftext", F.lit("")), 1, preview).alias("body_preview"),
                     F.coalesce(author, F.lit("[deleted]")).alias("author"), "score", "created_utc",
                     F.to_date("created_ts").alias("created_date"), "created_ts")


def resolve_columns(columns: list[str]) -> dict[str, str | None]:
    """Find broker CSV columns by substring of the lower-case header."""
    low = [c.strip().lower() for c in columns]

    def find(*parts):
        for c, lc in zip(columns, low):
            if any(p in lc for p in parts):
                return c
        return None
    return {"ticker": find("symbol", "ticker"), "action": find("action", "side", "type"),
            "date": find("date", "time"), "profit": find("profit", "pnl", "p&l"),
            "notes": find("note", "comment")}


def import_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Broker CSV import. Columns are found by header substring; rows
    without a ticker or with a ticker longer than 5 are skipped."""
    raw = spark.read.option("header", True).csv(path)
    return trades_from_frame(raw)


def trades_from_frame(raw: DataFrame) -> DataFrame:
    m = resolve_columns(raw.columns)

    def c(name, default):
        return F.trim(F.col(f"`{m[name]}`")) if m[name] else F.lit(default)
    ticker = F.upper(c("ticker", None))
    action = F.coalesce(F.nullif(F.upper(c("action", "")), F.lit("")), F.lit("BUY"))
    profit = F.coalesce(F.expr(f"try_cast(trim(`{m['profit']}`) AS DOUBLE)") if m["profit"] else F.lit(None),
                        F.lit(0.0))
    out = raw.select(ticker.alias("ticker"), action.alias("action"),
                     F.coalesce(c("date", ""), F.lit("")).alias("date"), profit.alias("profit"),
                     F.coalesce(F.nullif(c("notes", ""), F.lit("")),
                                F.concat_ws(" ", action, ticker)).alias("notes"))
    return out.filter(F.col("ticker").isNotNull() & (F.col("ticker") != "") & (F.length("ticker") <= 5))


def epoch_date(days_offset) -> F.Column:
    return F.date_add(F.lit(_dt.date(2024, 1, 1)), days_offset)
