"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: very long texts make short batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost
    executor rereads the table instead of repeating the work above it."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(docs: DataFrame, loc: str = "__loc") -> DataFrame:
    """``docs`` written once with each row's place in the stored column
    ``loc``. What needs a row twice reads both sides from this table: the
    splits of a second scan of the input may differ, and its places with them."""
    return stage(docs.withColumn(loc, F.monotonically_increasing_id()), "input")


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two input columns under fixed names; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the row offsets (n + 1) into them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("").cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def by_bytes(batch: pa.RecordBatch, col: int, most: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` text bytes (one row at least)."""
    _, off = utf8(batch.column(col))
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def give_back() -> None:
    """Return free memory to the system: Spark's Python workers wait for the
    next stage with whatever they hold."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and
    for each row the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words lower-cased (A-Z) with one space behind each, and their new
    starts and ends."""
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens + 1)))
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] = 1
    keep[ends] -= 1
    solid = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
    out = np.full(at[-1], 32, np.uint8)
    put = np.ones(at[-1], bool)
    put[at[1:] - 1] = False
    out[put] = low[solid]
    return out.tobytes(), at[:-1], at[1:] - 1
