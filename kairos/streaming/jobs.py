"""Structured Streaming operators.

Sources are file streams over day folders, read in day order; sinks are
``foreachBatch`` writers that overwrite the folder of their batch, so a
repeated batch changes nothing. Callers name the sink: its streaming
checkpoint lies beside it, and a job started again with the same path goes on
from its last committed batch. ``availableNow`` drains what is there and
stops, which is how tests and the registered queries run; production uses
``processingTime`` triggers. No answer depends on how many files or rows a
batch holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from ..sources import storage

#: Rows of one staged day may come in any order; batches never go back a day.
DISORDER = "1 day"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of a query in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def stage_by_day(df: DataFrame, ts: str, name: str, end_after: str | None = None, files_per_day: int | None = None) -> str:
    """Write a table as a file-stream source: one folder per day
    (``day=YYYY-MM-DD``) whose files are read in day order. Returns the path.

    ``end_after`` (an interval) adds one row of nulls so long after the last
    row: the watermark then passes every open window, and appended results
    are whole when the drained stream stops. Its own window never closes.
    ``files_per_day`` deals a day over several files.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    rows = df
    if end_after:
        last = df.agg((F.max(ts) + F.expr(f"INTERVAL {end_after}")).alias(ts))
        rows = df.unionByName(last.filter(F.col(ts).isNotNull()), allowMissingColumns=True)
    rows = rows.withColumn("day", F.to_date(ts))
    rows = rows.repartition("day") if not files_per_day else rows.repartition(files_per_day * 8, "day", F.pmod(F.xxhash64(ts), F.lit(files_per_day)))
    rows.write.partitionBy("day").parquet(path)
    storage.order_folders(spark, path)
    return path


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16, bytes_per_batch: int | None = None) -> DataFrame:
    """File stream over a staged folder. ``bytes_per_batch`` bounds a batch by
    its bytes instead of its files: where days grow in number and not in size,
    the batches then grow with the rows, not with the calendar."""
    limit = ("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else ("maxFilesPerTrigger", files_per_batch)
    return spark.readStream.schema(schema).option(*limit).parquet(path)


def run_batches(stream: DataFrame, out: str, fn=None, mode: str = "append", schema=None) -> DataFrame:
    """Drain ``stream`` into the table ``out`` and return it with its batch
    number (``__batch``); every micro-batch goes through ``fn(batch)`` (any
    batch operator) and overwrites its own folder."""
    spark = stream.sparkSession
    fn = fn or (lambda batch: batch)
    empty = schema or fn(spark.createDataFrame([], stream.schema)).schema

    def write(batch: DataFrame, epoch: int):
        fn(batch).write.mode("overwrite").parquet(f"{out}/__batch={epoch}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    full = T.StructType([*empty.fields, T.StructField("__batch", T.LongType())])
    if not storage.exists(spark, out):  # no batch came
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(out)


def run_to_table(stream: DataFrame, out: str, mode: str = "append", key_cols=None) -> DataFrame:
    """Drain ``stream`` into the table ``out``. ``append``: all batches.
    ``update``: changed rows, of which the latest batch's count for each of
    ``key_cols``."""
    res = run_batches(stream, out, mode=mode, schema=stream.schema)
    if mode == "update":
        cols = [c for c in stream.columns if c not in key_cols]
        last = F.max_by(F.struct(*cols), "__batch").alias("__last")
        return res.groupBy(*key_cols).agg(last).select(*key_cols, *[F.col(f"__last.{c}").alias(c) for c in cols])
    return res.drop("__batch")


def windowed_counts(stream: DataFrame, ts="ts", kind="tumbling", by=("event_type",), value="value",
                    size="1 hour", slide="30 minutes", gap="30 minutes", watermark=DISORDER) -> DataFrame:
    """Event-time windows with a watermark: tumbling, sliding or session
    windows, count and mean value, appended once the watermark has passed
    them. Later rows are dropped and closed windows leave the state."""
    s = stream.withWatermark(ts, watermark)
    if kind == "tumbling":
        wcol = F.window(ts, size)
    elif kind == "sliding":
        wcol = F.window(ts, size, slide)
    else:
        wcol = F.session_window(ts, gap)
    g = s.groupBy(wcol.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "avg_value")


def stream_dedupe(stream: DataFrame, keys, ts="ts", tie="event_id", size="1 hour", watermark=DISORDER) -> DataFrame:
    """I8: of the rows of a key in each ``size`` window the first by time
    (then ``tie``) stays. State is one row for each key of an open window."""
    cols = [c for c in stream.columns if c not in (ts, tie)]
    first = F.min(F.struct(ts, tie, *cols)).alias("r")
    g = stream.withWatermark(ts, watermark).groupBy(F.window(ts, size).alias("w"), *[F.col(k).alias(f"__{k}") for k in keys]).agg(first)
    return g.select(*[F.col(f"r.{c}").alias(c) for c in stream.columns])


def leaderboard(stream: DataFrame, agent="user_id", profit="profit", ts="ts") -> DataFrame:
    """Running totals of each agent: trades, wins (profit not negative),
    profit, last trade time. One state row for each agent, kept for ever."""
    return stream.groupBy(agent).agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col(profit) >= 0).alias("wins"),
                                     F.sum(profit).alias("profit"), F.max(ts).alias("last_trade"))


def stream_quality(stream: DataFrame, out: str, value="value", user="user_id") -> DataFrame:
    """Rule checks of each day. A batch writes its counts by (day, user),
    and the days are put together from all batches, so a day may come in any
    number of files and batches and a batch may hold many days."""
    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy("day", user).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("null_values"),
                                              F.count_if(F.col(value) < 0).alias("negative_values"))

    parts = run_batches(stream, out, counts)
    return parts.groupBy("day").agg(F.sum("rows").alias("rows"), F.sum("null_values").alias("null_values"),
                                    F.sum("negative_values").alias("negative_values"), F.count_distinct(user).alias("users"))


def pending_dates(silver: DataFrame, gold_path: str, t="dt", start=None) -> DataFrame:
    """Silver dates (from ``start`` on) that are not yet in gold."""
    spark = silver.sparkSession
    dates = silver.select(t).distinct()
    if start is not None:
        dates = dates.filter(F.col(t) >= F.lit(start))
    if not storage.exists(spark, gold_path):
        return dates
    return dates.join(gold_rows(spark, gold_path).select(t).distinct(), t, "left_anti")


def gold_rows(spark: SparkSession, gold_path: str) -> DataFrame:
    """The rows that ``advance`` has written."""
    return spark.read.parquet(gold_path).drop("run")


def advance(silver: DataFrame, gold_path: str, score_fn, days: int | None = 1, t="dt", start=None) -> list:
    """Score the next ``days`` silver dates not yet in gold (None: all of
    them) and write them as one partition, named by the first of them: a run
    that is repeated replaces its partition and never doubles a date. Returns
    the dates written; none are left when it is empty."""
    nxt = pending_dates(silver, gold_path, t, start).orderBy(t)
    if days is not None:
        nxt = nxt.limit(days)
    dates = [r[0] for r in nxt.collect()]  # calendar dates
    if dates:
        todo = silver.filter(F.col(t).between(dates[0], dates[-1])).join(F.broadcast(nxt), t, "left_semi")
        score_fn(todo).write.mode("overwrite").parquet(f"{gold_path}/run={dates[0]}")
    return dates


def advance_or_wrap(silver: DataFrame, gold_path: str, score_fn, days: int | None = 1, t="dt", start=None) -> list:
    """As ``advance``; when no date is left, clear gold and start
    again from the first date."""
    done = advance(silver, gold_path, score_fn, days, t, start)
    if not done and storage.exists(silver.sparkSession, gold_path):
        reset(silver.sparkSession, gold_path)
        done = advance(silver, gold_path, score_fn, days, t, start)
    return done


def reset(spark: SparkSession, gold_path: str) -> None:
    """Clear gold."""
    storage.delete(spark, gold_path)


def reset_start_date(silver: DataFrame, n=100, k="ticker", t="dt"):
    """The first date with at least ``n`` instruments (restart point)."""
    d = silver.groupBy(t).agg(F.count_distinct(k).alias("__k")).filter(F.col("__k") >= n)
    return d.agg(F.min(t).alias("start_date"))


def stream_flows(requests: DataFrame, flows: DataFrame, out: str, k=10, keys=("scenario_id", "dt"),
                 order=("urgency", "archetype_id")) -> DataFrame:
    """Answer each streamed (scenario, date) request with the top ``k``
    decisions of that date by urgency (stream-static join per batch). A
    request that comes in two batches is answered twice with the same rows."""
    from ..operators.ranking import top_k_per_group
    keys = list(keys)

    def answer(batch: DataFrame) -> DataFrame:
        j = batch.select(*keys).distinct().join(flows, keys)
        return top_k_per_group(j, keys, [F.col(order[0]).desc(), F.col(order[1])], k, out="rank")

    return run_batches(requests, out, answer).drop("__batch").dropDuplicates([*keys, "rank"])
