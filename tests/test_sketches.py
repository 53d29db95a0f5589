"""Quantiles from merged sketches keep their stated rank error."""

import datetime as dt

from pyspark.sql import functions as F

from kairos.operators import sketches as K
from kairos.streaming import jobs as S


def table(spark, n=40000):
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 70).cast("int"))
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")))
    return spark.range(n).select(key.alias("k"), day.alias("day"), F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(100003)).cast("double")).alias("v"))


def test_rank_error_and_counts(spark):
    df = table(spark)
    path = S.shared_path(spark, "sketches")
    K.store_sketches(df, path, ["k"], "day", "v")
    january = df.filter("day < DATE '2024-02-01'")
    K.store_sketches(january, path, ["k"], "day", "v")  # a month again
    got = K.sketched_quantiles(spark.read.parquet(path), ["k"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()
    values = {}
    for r in df.collect():
        if r["v"] is not None:
            values.setdefault(r["k"], []).append(r["v"])
    assert len(got) == 5 * len(values) and None in values
    for r in got:
        v = values[r["k"]]
        below, up_to = sum(x < r["estimate"] for x in v) / len(v), sum(x <= r["estimate"] for x in v) / len(v)
        assert r["n"] == len(v) and r["estimate"] in v
        assert below <= r["p"] + K.RANK_ERROR and up_to >= r["p"] - K.RANK_ERROR


def test_rank_interval_is_exact(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 3)] + [("a", None), ("b", 5.0)], "k string, v double")
    e = spark.createDataFrame([("a", 0.5, 4, 2.0), ("b", 0.5, 1, 5.0)], "k string, p double, n long, estimate double")
    assert sorted(tuple(r) for r in K.rank_interval(df, ["k"], "v", e).collect()) == [("a", 0.5, 4, 2.0, 4, 0.25, 0.75), ("b", 0.5, 1, 5.0, 1, 0.0, 1.0)]


def test_empty(spark):
    df = table(spark).limit(0)
    assert K.sketched_quantiles(K.day_sketches(df, ["k"], "day", "v"), ["k"], [0.5]).count() == 0
