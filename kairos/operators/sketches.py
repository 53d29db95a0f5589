"""Quantiles from stored sketches (D8): one KLL sketch for each group and day,
kept in a table and merged when asked, so that a new day reads only its rows.

Sketches are built and merged by Spark's aggregates, map-side first: a group
of any size is a few kilobytes in each task. ``SIZE`` = 800 keeps the rank of an
estimate within ``RANK_ERROR`` = 0.01 of the wanted one (the sketch's bound at
99 % is 2.296 / SIZE ** 0.9021 = 0.0055). Nulls are left out; a group without
values has no row. Estimates are values of the input; reruns may pick others
within the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import append_day

SIZE, RANK_ERROR = 800, 0.01


def day_sketches(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """One sketch for each group and day."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, day).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias("sketch"))


def store_sketches(df: DataFrame, path: str, by: list[str], day: str, value: str) -> None:
    """Write the sketches of the months in ``df``, a folder each; a month
    written again is replaced, so ``df`` holds whole months."""
    out = day_sketches(df, by, day, value).withColumn("month", F.date_format(day, "yyyy-MM"))
    append_day(out.repartition("month"), path, "month")


def sketched_quantiles(sketches: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """(group, p, n, estimate) from the merged sketches of any days."""
    g = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", SIZE).alias("__k"))
    one = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_n_double("__k").alias("n"), F.kll_sketch_get_quantile_double("__k", F.lit(float(p))).alias("estimate"))
           for p in ps]
    return g.select(*by, F.inline(F.array(*one)))


def rank_interval(df: DataFrame, by: list[str], value: str, estimates: DataFrame) -> DataFrame:
    """The estimates with their true ranks: shares of the group's values below
    (``below``) and not above (``up_to``) the estimate, in one pass. Groups
    with a null key are left out."""
    e = estimates.groupBy(*by).agg(F.collect_list(F.struct("p", "n", "estimate")).alias("__e"))  # a few probabilities each
    x = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL").join(e, by)
    x = x.select(*by, "__v", F.inline("__e"))
    g = x.groupBy(*by, "p", "n", "estimate").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__v") < F.col("estimate")).alias("__lt"),
                                                 F.count_if(F.col("__v") <= F.col("estimate")).alias("__le"))
    return g.select(*by, "p", "n", "estimate", "rows", (F.col("__lt") / F.col("rows")).alias("below"), (F.col("__le") / F.col("rows")).alias("up_to"))
