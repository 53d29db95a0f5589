"""Aggregations (D1-D33). Every one is a ``groupBy().agg`` (partial
aggregation before the shuffle) or a window over a bounded key; exact
quantiles of a few large groups use histograms (``exact_quantiles``), those of
many small groups ``percentile``; both interpolate linearly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div
from ..session import layer_table


def profile(df: DataFrame, key: str, t: str, cols) -> DataFrame:
    """Rows, distinct keys, date range and null counts in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"),
            F.min(t).alias("min_date"), F.max(t).alias("max_date")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]
    return df.agg(*aggs)


def summarise(df: DataFrame, by, col: str, digits=4) -> DataFrame:
    """Grouped count/mean/min/max/std of one column, rounded."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(col), digits).alias(f"avg_{col}"),
        F.round(F.min(col), digits).alias(f"min_{col}"), F.round(F.max(col), digits).alias(f"max_{col}"),
        F.round(F.stddev_samp(col), digits).alias(f"std_{col}"))


def coverage(df: DataFrame, k="ticker", t="dt", volume="volume") -> DataFrame:
    """Rows, first and last date and mean volume per key."""
    return df.groupBy(k).agg(F.count(F.lit(1)).alias("rows"), F.min(t).alias("first_date"),
                             F.max(t).alias("last_date"), F.avg(volume).alias("avg_volume"))


def return_stats(df: DataFrame, k="ticker", ret="daily_return") -> DataFrame:
    """Mean, std, adjusted skew, annualised return/vol and Sharpe."""
    n = F.count(ret)
    g = df.groupBy(k).agg(n.alias("n"), F.avg(ret).alias("mean_return"),
                          F.stddev_samp(ret).alias("std_return"), F.skewness(ret).alias("__g1"))
    adj = F.when(F.col("n") > 2, F.col("__g1") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2))
    g = g.withColumns({"skew": adj, "ann_return": F.col("mean_return") * F.lit(252.0),
                       "ann_vol": F.col("std_return") * F.sqrt(F.lit(252.0))})
    return g.withColumn("sharpe", div("ann_return", "ann_vol")).drop("__g1")


def approx_quantile_by(df: DataFrame, k, col: str, p=0.5, accuracy=10000) -> DataFrame:
    """Approximate quantile per group (``percentile_approx``)."""
    k = [k] if isinstance(k, str) else list(k)
    return df.groupBy(*k).agg(F.percentile_approx(col, p, accuracy).alias(f"{col}_q"))


def with_quantile(df: DataFrame, k, col: str, p: float, out: str) -> DataFrame:
    """Exact group quantile as a column on every row."""
    ws = Window.partitionBy(*([k] if isinstance(k, str) else k))
    return df.withColumn(out, F.percentile(col, p).over(ws))


def score_distribution(df: DataFrame, score="signal_score", lo=0, hi=5) -> DataFrame:
    """Histogram of a small integer score with zero bins and share."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(score))
    h = bins.join(F.broadcast(counts), score, "left").fillna({"n": 0})
    return h.withColumn("pct", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()))


def modal_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value; ties go to the smallest value."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min_by(col, F.struct((-F.col("n")).alias("a"), F.col(col).alias("b"))).alias("mode"))


def pivot_wide(df: DataFrame, row: str, col: str, val: str, values=None) -> DataFrame:
    """Long -> wide, first value per cell (``values`` avoids the extra
    distinct job when the column set is known)."""
    return df.groupBy(row).pivot(col, values).agg(F.first(val))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per (a, b) with row, column and grand totals (cube)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, k) -> DataFrame:
    """Keys that occur more than once."""
    k = [k] if isinstance(k, str) else list(k)
    return df.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def first_date_with(df: DataFrame, n: int, k="ticker", t="dt") -> DataFrame:
    """First date with at least ``n`` distinct keys."""
    d = df.groupBy(t).agg(F.count_distinct(k).alias("keys")).filter(F.col("keys") >= n)
    return d.agg(F.min(t).alias("first_date"))


def exact_quantiles(df: DataFrame, k, col: str, ps, limit=10_000, bins=1024) -> DataFrame:
    """(keys, p, value): exact quantiles of each group, interpolated between
    neighbours, without a buffer or a sort of a whole group.

    The wanted ranks lie between a least and a greatest value; while more than
    ``limit`` rows lie there, a histogram of ``bins`` equal parts (combined
    map-side) shows the part that holds the rank. Then the few rows left are
    numbered. Null and NaN values don't count; a group without values has
    no row. The state is one row for each group and rank.
    """
    k = [k] if isinstance(k, str) else list(k)
    x = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(k)], F.col(col).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    keys = [f"k{i}" for i in range(len(k))]
    at = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")) if keys else \
        x.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("c > 0")
    at = at.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("pos", F.col("p") * (F.col("c") - 1))
    at = at.withColumn("rank", F.explode(F.array(F.floor("pos"), F.ceil("pos")).cast("array<long>"))).dropDuplicates([*keys, "p", "rank"])
    at = layer_table(at.withColumns({"id": F.monotonically_increasing_id(), "base": F.lit(0).cast("long")}), "quantiles")

    def meet(t):
        same = reduce(lambda a, b: a & b, [x[c].eqNullSafe(t[c]) for c in keys], F.lit(True))
        return x.join(F.broadcast(t) if t.count() <= 100_000 else t, same & (x["v"] >= t["lo"]) & (x["v"] <= t["hi"]))

    while not (wide := at.filter(f"c > {limit} AND lo < hi")).isEmpty():
        # The width of a finite range may overflow: halve before subtracting.
        part = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)
        h = meet(wide).groupBy("id", "rank", "base", F.least(F.lit(bins - 1), part).alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("nlo"), F.max("v").alias("nhi"))
        upto = F.sum("n").over(Window.partitionBy("id").orderBy("part"))  # at most ``bins`` rows
        h = h.withColumn("upto", F.col("base") + upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        h = h.select("id", F.col("n").alias("nc"), "nlo", "nhi", (F.col("upto") - F.col("n")).alias("nbase"))
        at = layer_table(at.join(h, "id", "left").select(
            *keys, "p", "pos", "rank", "id", F.coalesce("nc", "c").alias("c"), F.coalesce("nlo", "lo").alias("lo"),
            F.coalesce("nhi", "hi").alias("hi"), F.coalesce("nbase", "base").alias("base")), "quantiles")
    few = meet(at.filter("lo < hi")).select("id", "rank", "base", "v").withColumn(
        "at", F.col("base") + F.row_number().over(Window.partitionBy("id").orderBy("v")) - 1).filter("at = rank").select("id", F.col("v").alias("found"))
    got = at.join(few, "id", "left").select(*keys, "p", "pos", F.struct("rank", F.coalesce("found", "lo").alias("v")).alias("r"))
    got = got.groupBy(*keys, "p").agg(F.first("pos").alias("pos"), F.min("r").alias("a"), F.max("r").alias("b"))
    part = F.col("pos") - F.col("a.rank")
    value = F.when(F.col("a.rank") == F.col("b.rank"), F.col("a.v")).otherwise((1 - part) * F.col("a.v") + part * F.col("b.v"))
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(k)], "p", value.alias("value"))


def returns_by_score(df: DataFrame, score="signal_score", fwd="fwd_60d_median") -> DataFrame:
    """Count, exact median and mean forward value per score tier."""
    g = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.avg(fwd).alias("mean_fwd"))
    med = exact_quantiles(df, score, fwd, [0.5]).select(F.col(score).alias("__s"), F.col("value").alias("median_fwd"))
    return g.join(med, F.col(score).eqNullSafe(F.col("__s")), "left").select(score, "n", "median_fwd", "mean_fwd")


def flagged_vs_baseline(df: DataFrame, score="signal_score", fwd="fwd_60d_median") -> DataFrame:
    """Exact median forward value of flagged (score >= 1) vs unflagged rows."""
    side = F.when(F.col(score) >= 1, "flagged").when(F.col(score) == 0, "baseline")
    med = exact_quantiles(df.withColumn("__side", side).filter("__side IS NOT NULL"), "__side", fwd, [0.5])
    med = {r["__side"]: r["value"] for r in med.collect()}  # two numbers
    g = df.agg(F.count_if(F.col(score) >= 1).alias("flagged_count"), F.count_if(F.col(score) == 0).alias("baseline_count"))
    g = g.select(F.lit(med.get("flagged", 0.0)).alias("flagged_median"), F.lit(med.get("baseline", 0.0)).alias("baseline_median"),
                 "flagged_count", "baseline_count")
    return g.withColumn("alpha", F.col("flagged_median") - F.col("baseline_median"))


def signal_precision(df: DataFrame, flags, fwd="fwd_60d_median") -> DataFrame:
    """Per flag: holders, share with a positive forward value, mean."""
    stack = ", ".join(f"'{f}', {f}" for f in flags)
    long = df.select(fwd, F.expr(f"stack({len(flags)}, {stack}) AS (signal, held)"))
    held = long.filter(F.col("held"))
    return held.groupBy("signal").agg(
        F.count(F.lit(1)).alias("holders"),
        (F.count_if(F.col(fwd) > 0) / F.count(F.lit(1))).alias("precision"),
        F.coalesce(F.avg(fwd), F.lit(0.0)).alias("avg_fwd"))


def dip_signal(df: DataFrame, dd=-0.15, score="signal_score", fwd="fwd_60d_median") -> DataFrame:
    """Flagged rows in deep drawdown: count and mean forward value."""
    sub = F.col("drawdown_pct") < dd
    flagged = F.col(score) >= 1
    return df.agg(F.count_if(sub & flagged).alias("deep_flagged_count"),
                  F.coalesce(F.avg(F.when(sub & flagged, F.col(fwd))), F.lit(0.0)).alias("avg_fwd"))


def monthly_activity(df: DataFrame, flags, t="dt") -> DataFrame:
    """Monthly flag sums and top-tier event counts."""
    m = F.date_trunc("month", F.col(t)).cast("date").alias("month")
    return df.groupBy(m).agg(*[F.sum(F.col(f).cast("int")).cast("long").alias(f) for f in flags],
                             F.count_if(F.col("top_tier")).alias("top_tier_events"))


def sector_means(df: DataFrame, cols, by="sector") -> DataFrame:
    """Per-sector means."""
    return df.groupBy(by).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def mean_daily_counts(df: DataFrame, score="signal_score", t="dt", lo=0, hi=5) -> DataFrame:
    """Mean number of rows per day for each score, zero-filled."""
    per = df.groupBy(t, score).agg(F.count(F.lit(1)).alias("n"))
    # The zero-filled grid: every day expanded to the fixed score range.
    grid = df.select(t).distinct().select(t, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias(score))
    full = grid.join(per, [t, score], "left").fillna({"n": 0})
    return full.groupBy(score).agg(F.avg("n").alias("avg_per_day"))


def describe(df: DataFrame) -> DataFrame:
    """Summary statistics for every column (``summary``)."""
    return df.summary("count", "mean", "stddev", "min", "max")
