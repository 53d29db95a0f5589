"""Streams give the same rows for any batch size and file layout."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from kairos.streaming import jobs as S


def events(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.filter("ts < '2024-01-05'")  # four days


def staged(spark, end_after=None, files_per_day=None):
    ev = events(spark)
    path = S.stage_by_day(ev, "ts", "t", end_after, files_per_day)
    return lambda n: S.read_stream(spark, path, T.StructType([*ev.schema.fields, T.StructField("day", T.DateType())]), n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


JOBS = {
    "tumbling": ("5 days", lambda sp, st: S.run_to_table(S.windowed_counts(st), S.shared_path(sp, "t")).select("window_start", "event_type", "n")),
    "sessions": ("5 days", lambda sp, st: S.run_to_table(S.windowed_counts(st, kind="session", by=("user_id",), gap="12 hours"),
                                                          S.shared_path(sp, "t")).select("window_start", "window_end", "user_id", "n")),
    "dedupe": ("5 days", lambda sp, st: S.run_to_table(S.stream_dedupe(st.drop("day"), ["user_id", "event_type"]), S.shared_path(sp, "t")).select("event_id", "ts")),
    "leaderboard": (None, lambda sp, st: S.run_to_table(S.leaderboard(st.withColumn("profit", F.col("value") - 10)), S.shared_path(sp, "t"), "update",
                                                        ["user_id"]).select("user_id", "trades", "wins", "last_trade")),
    "quality": (None, lambda sp, st: S.stream_quality(st, S.shared_path(sp, "t")).select("day", "rows", "null_values", "negative_values", "users")),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_batches_and_files_do_not_matter(spark, name):
    end, job = JOBS[name]
    one = staged(spark, end)
    many = staged(spark, end, files_per_day=3)
    first = rows(job(spark, one(64)))
    assert first and rows(job(spark, one(1))) == first and rows(job(spark, many(4))) == first


def test_dedupe_keeps_the_first_of_each_hour(spark):
    got = {r[0] for r in rows(JOBS["dedupe"][1](spark, staged(spark, "5 days")(16)))}
    best = {}
    for r in events(spark).collect():
        k = (r["user_id"], r["event_type"], r["ts"].replace(minute=0, second=0, microsecond=0))
        best[k] = min(best.get(k, (r["ts"], r["event_id"])), (r["ts"], r["event_id"]))
    assert got == {e for _, e in best.values()}


def test_late_rows_are_dropped(spark):
    day = lambda n: dt.datetime(2024, 1, n, 12)
    schema = "event_type string, value double, ts timestamp"
    path = S.stage_by_day(spark.createDataFrame([("a", 1.0, day(1)), ("a", 3.0, day(5)), ("b", 2.0, day(6))], schema), "ts", "late")
    late = spark.createDataFrame([("a", 100.0, day(1)), ("a", 5.0, day(5)), ("end", 0.0, day(20))], schema)
    late.withColumn("day", F.to_date(F.lit("2024-01-07"))).repartition(1).write.partitionBy("day").mode("append").parquet(path)
    from kairos.sources import storage
    storage.order_folders(spark, path)
    st = S.read_stream(spark, path, T.StructType([*late.schema.fields, T.StructField("day", T.DateType())]), 1)
    got = rows(S.run_to_table(S.windowed_counts(st), S.shared_path(spark, "late")).select("event_type", "n", "avg_value"))
    assert got == [("a", 1, 1.0), ("a", 2, 4.0), ("b", 1, 2.0)]


def test_same_path_goes_on_where_it_stopped(spark):
    read = staged(spark)
    out = S.shared_path(spark, "again")
    st = read(8).select("event_id")
    first = rows(S.run_to_table(st, out))
    assert rows(S.run_to_table(st, out)) == first and len(first) == events(spark).count()


def test_empty_stream(spark):
    path = S.stage_by_day(events(spark).limit(0), "ts", "none")
    schema = T.StructType([*events(spark).schema.fields, T.StructField("day", T.DateType())])
    assert S.run_to_table(S.read_stream(spark, path, schema), S.shared_path(spark, "none")).count() == 0


def test_advance_reset_and_wrap(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 5, 9)]
    silver = spark.createDataFrame([(k, d, float(i)) for i, d in enumerate(days) for k in "ab"], "ticker string, dt date, x double")
    path = S.shared_path(spark, "gold")
    score = lambda d: d.withColumn("s", F.col("x") * 2)
    steps = [S.advance_or_wrap(silver, path, score) for _ in range(4)]
    assert steps == [[d] for d in days]
    assert rows(S.gold_rows(spark, path).select("ticker", "dt", "s")) == rows(score(silver).select("ticker", "dt", "s"))
    assert S.advance(silver, path, score) == []
    assert S.advance_or_wrap(silver, path, score) == [days[0]]
    assert S.gold_rows(spark, path).count() == 2
    assert S.advance(silver, path, score, days=None) == days[1:]
    S.reset(spark, path)
    assert S.advance(silver, path, score, days=2, start=days[2]) == days[2:]


def test_news_batches_do_not_grow_with_the_days(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from kairos.sources import storage
    posts = [(24 * day, 1, "user", f"the beta word {day}") for day in range(40)]
    spark.createDataFrame(posts, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "Beta with word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(S, "shared_path", lambda sp, name: f"{tmp_path}/{name}")
    got = sorted(tuple(r) for r in entry.queries()["stream_news"](spark, str(tmp_path)).select("id", "symbol").collect())
    assert got == sorted((f"{24 * day}-1", w) for day in range(40) for w in ("BETA", "WORD"))
    assert sum(n.startswith("__batch=") for n, _, _ in storage.listing(spark, f"{tmp_path}/news")) == 1
