"""Parquet scans and managed-table writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, versions

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one input table. Column pruning and filters reach the scan
    through Catalyst, so callers just ``select``/``filter`` afterwards."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: load(spark, sf_dir, n) for n in names}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A5: parquet scan."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet sink; overwrite replaces data and schema."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def ensure_layers(spark: SparkSession, layers=("bronze", "silver", "gold", "ml_models")) -> None:
    """Layer DDL (databases)."""
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")


def read_first(spark: SparkSession, *names: str) -> DataFrame:
    """The first table that exists, among catalog names or paths."""
    for n in names:
        if "/" in n:
            if storage.exists(spark, n):
                return spark.read.parquet(n)
        elif spark.catalog.tableExists(n):
            return spark.table(n)
    raise ValueError(f"none of the tables exists: {names}")


def append_day(df: DataFrame, path: str, date_col: str = "dt") -> None:
    """Idempotent append of one or more dates.

    Writes with dynamic partition overwrite, so writing the same date twice
    replaces that date's partition instead of doubling its rows (S31).
    """
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(date_col).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def reset_table(spark: SparkSession, path: str, schema) -> None:
    """Clear a table (empty overwrite keeps the schema)."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_version(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Commit a new version of the table at ``path``; returns its number."""
    return versions.write(df, path, mode)


def history(spark: SparkSession, path: str) -> DataFrame:
    """The versions present, with their time, files and columns."""
    return versions.history(spark, path)


def read_version(spark: SparkSession, path: str, version: int | None = None, as_of_ms: int | None = None) -> DataFrame:
    """Read as of a version or a time (latest when both are None)."""
    return versions.read(spark, path, version, as_of_ms)
