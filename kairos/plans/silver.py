"""The daily feature table (silver): one row per (ticker, dt).

One chain of window operators over ``partitionBy(ticker).orderBy(dt)``;
Catalyst plans a single exchange by ticker and reuses its sort for every
frame. The benchmark join is a broadcast of one row per date, which keeps
the ticker partitioning, so no later window re-shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import windows as E
from .fixtures import BENCHMARK


def core_features(bars: DataFrame) -> DataFrame:
    """Returns, drawdown and the three full-history ranks."""
    df = E.with_returns(bars)
    df = E.with_drawdown(df)
    df = E.with_realised_vol(df)
    df = E.with_percent_rank(df, "drawdown_pct", "drawdown_percentile")
    df = E.with_percent_rank(df, "realized_vol_20d", "vol_percentile", round_digits=10)
    df = E.with_percent_rank(df, "volume", "volume_percentile")
    return df


def benchmark_features(bars: DataFrame, benchmark=BENCHMARK, q=0.8) -> DataFrame:
    """C3 + E27 inputs: the benchmark's return, close, 20-day vol and the
    ``q`` quantile of that vol, one row per date.

    Computed from the benchmark's own bars only (a one-instrument chain),
    so it is bounded by the calendar and is broadcast to the fact side.
    The threshold is a window over these rows: the scalar never passes
    through the driver and no cross join is planned.
    """
    b = bars.filter(F.col("ticker") == benchmark)
    b = E.with_realised_vol(E.with_returns(b), ns=(20,))
    b = b.select(F.col("dt").alias("__bt"), F.col("daily_return").alias("bench_return"),
                 F.col("close").alias("bench_close"), F.col("realized_vol_20d").alias("bench_vol_20d"))
    return b.withColumn("bench_vol_threshold", F.percentile("bench_vol_20d", q).over(Window.partitionBy()))


def with_bench(df: DataFrame, bench: DataFrame) -> DataFrame:
    """Broadcast join of the per-date benchmark row; keeps the ticker
    partitioning of ``df`` so later windows do not re-shuffle."""
    df = df.join(F.broadcast(bench), F.col("dt") == F.col("__bt"), "left").drop("__bt")
    return df.withColumn("vol_regime", F.when(F.col("bench_vol_20d") < F.col("bench_vol_threshold"),
                                              F.lit("favorable")).otherwise(F.lit("elevated")))


def daily_features(bars: DataFrame, benchmark=BENCHMARK, rsi_zero_loss="cap",
                   macd_kind="sma") -> DataFrame:
    """All silver features.

    ``bars`` is read twice (instruments and benchmark): pass a materialised
    table (``fixtures.bars_table``) so the second read is a scan, not a
    recomputation of the bar aggregation.
    """
    df = core_features(bars)
    df = E.with_rsi(df, zero_loss=rsi_zero_loss)
    df = E.with_macd(df, kind=macd_kind)
    df = E.with_bollinger(df)
    df = E.with_atr(df)
    df = E.with_roc(df)
    df = E.with_zscore(df)
    df = with_bench(df, benchmark_features(bars, benchmark))
    df = E.with_relative_return(df)
    df = E.with_percent_rank(df, "relative_return_20d", "relative_return_percentile", round_digits=10)
    df = E.with_forward_return(df)
    df = E.with_forward_distribution(df)
    df = E.with_mean_reversion(df)
    df = df.withColumn("median_drawdown",
                       F.percentile("drawdown_pct", 0.5).over(Window.partitionBy("ticker")))
    return df


def _written(spark, sf_dir: str):
    """(folder, schema) of the feature table, written once per application and
    input version. Rules of the bars and of the features are observed in that
    pass (it is the first one by instrument and keeps every bar)."""
    from ..operators.observed import bronze_rules, layer_path, silver_rules, write_observed
    from . import fixtures as FX
    key = ("silver", spark.sparkContext.applicationId, sf_dir, FX.stamp(spark, sf_dir))
    if key not in FX._TABLES:
        df = daily_features(FX.bars_table(spark, sf_dir))
        path = layer_path(spark, "silver")
        write_observed(df, path, {"bronze": bronze_rules(), "silver": silver_rules()})
        FX._TABLES[key] = path, df.schema
    return FX._TABLES[key]


def silver_path(spark, sf_dir: str) -> str:
    return _written(spark, sf_dir)[0]


def silver_table(spark, sf_dir: str) -> DataFrame:
    """The feature table (a Parquet table in the shared folder, so readers
    scan only their columns)."""
    path, schema = _written(spark, sf_dir)
    return spark.read.schema(schema).parquet(path)
