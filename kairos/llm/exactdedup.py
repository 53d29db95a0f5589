"""Exact deduplication by a keyed stream without expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, placed, stage, stage_path

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small stores: no space set aside for each one's logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # Stores of a stream that has ended are unloaded soon.
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def _with_conf(spark: SparkSession, conf: dict, run):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def located(docs: DataFrame, id_col: str, text_col: str, digest, loc=None) -> DataFrame:
    """(doc_id, loc, digest): ``loc`` is the row's place, a stored column of
    ``placed`` tables."""
    loc = F.monotonically_increasing_id() if loc is None else loc
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), loc.alias("loc"),
                       digest(norm).alias("digest"))


def sha256(norm):
    return F.sha2(norm, 256)


def stream_state(rows: DataFrame, files_per_batch: int = 512) -> DataFrame:
    """Final keyed state (digest, keep_id, keep_loc, n) of the written table
    ``rows`` read as a stream.

    State lives in RocksDB, checkpointed to the shared folder, without
    watermark or expiry: per digest the stable id (largest doc_id, then
    largest place), its content locator and the number of rows. Each batch
    overwrites its own folder of changed keys, so a repeated batch changes
    nothing; the last change of a key is its state.
    """
    spark = rows.sparkSession
    src = rows.inputFiles()
    schema = "digest string, keep_id long, keep_loc long, n long"
    if not src:
        return spark.createDataFrame([], schema)
    out, ckpt = stage_path(spark, "dedup-state"), stage_path(spark, "dedup-ckpt")
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(src[0].rsplit("/", 1)[0]))
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "loc")).alias("k"), F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, epoch: int):
        batch.select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.loc").alias("keep_loc"), "n").write.mode(
            "overwrite").parquet(f"{out}/batch={epoch}")

    def run():
        q = (stream_writer(state, write, ckpt)).start()
        q.awaitTermination()
        return q.lastProgress

    last = _with_conf(spark, ROCKS, run)
    if last is None:
        return spark.createDataFrame([], schema)
    changes = spark.read.schema(schema + ", batch long").parquet(out)
    # n only grows, so the row with the largest n is the last one.
    return changes.groupBy("digest").agg(F.max(F.struct("n", "keep_id", "keep_loc")).alias("s")).select(
        "digest", "s.keep_id", "s.keep_loc", "s.n")


def stream_writer(state: DataFrame, write, ckpt: str):
    return (state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
            .trigger(availableNow=True))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, rounds: int = 50) -> DataFrame:
    """(doc_id, loc, digest, keep_id, keep_loc, group_size) of every row.

    A round streams the rows still undecided through ``stream_state``; each
    row whose digest was hit by another is compared, full normalised bytes,
    with the content at the state's locator. Rows that equal it are decided;
    rows that only share the digest go into the next round by themselves.
    With SHA-256 the second round is empty; weak digests (tests) take one
    round for each different text of a digest. Every round decides at least
    the kept row of each digest, so it ends; ``rounds`` is a guard.
    """
    return _decide(placed(docs.select(id_col, text_col)), id_col, text_col, digest, rounds)


def _decide(docs: DataFrame, id_col: str, text_col: str, digest=sha256, rounds: int = 50, place: str = "__loc") -> DataFrame:
    """``decisions`` on a ``placed`` table."""
    rows = stage(located(docs, id_col, text_col, digest, F.col(place)), "digests")
    texts = docs.select(F.col(place).alias("loc"),
                        ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    done = []
    for _ in range(rounds):
        state = stage(stream_state(rows), "dedup-final")
        joined = rows.join(state, "digest")
        alone = joined.filter("n = 1")
        hits = joined.filter("n > 1").select("digest", "doc_id", "loc", "keep_id", "keep_loc")
        # Only rows of hit digests bring their text; the kept row's text
        # meets its copies as a row of a join, whose large keys are split.
        full = hits.join(texts, "loc")
        kept = full.filter("loc = keep_loc").select("digest", F.col("norm").alias("kept_norm"))
        checked = stage(full.join(kept, "digest").select(
            "digest", "doc_id", "loc", "keep_id", "keep_loc", (F.col("norm") == F.col("kept_norm")).alias("same")), "dedup-checked")
        sizes = checked.filter("same").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        cols = ["doc_id", "loc", "digest", "keep_id", "keep_loc", "group_size"]
        done += [alone.withColumn("group_size", F.lit(1).cast("long")).select(cols),
                 checked.filter("same").join(sizes, "digest").select(cols)]
        rest = checked.filter("not same")
        if rest.isEmpty():
            break
        rows = stage(rest.select("doc_id", "loc", "digest"), "digests")
    else:
        raise RuntimeError("exact dedup did not finish")
    return reduce(DataFrame.unionByName, done)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as
    empty. The row with the largest doc_id stays (null ids lose to any id);
    of repeated rows with that id exactly one stays. An empty table gives an
    empty result; other columns are not read.
    """
    d = decisions(docs, id_col, text_col, digest)
    return d.select("doc_id", "keep_id", "group_size", (F.col("loc") == F.col("keep_loc")).alias("kept"),
                    F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, all columns unchanged,
    whatever their names."""
    place = free_name(docs, "__loc")
    docs = placed(docs, place)
    gone = stage(_decide(docs, id_col, text_col, place=place).filter("loc <> keep_loc").select(F.col("loc").alias(place)), "dropped")
    return docs.join(gone, place, "left_anti").drop(place)
