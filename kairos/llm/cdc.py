"""Document fingerprints by content-defined chunking."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, prepare, utf8

LEAST, NORMAL, MOST = 16, 64, 255  # bytes of a chunk
#: Bits that must be zero for a border: more before the normal size, fewer after.
STRICT, LOOSE = 7, 4
HELD = 1 << 19  # bytes of texts that are hashed together
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes up to each position: sum of GEAR[b] shifted
    by the byte's distance, by doubling steps over the whole array."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    return h


def borders(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of possible chunks: strict ones, and strict or loose ones."""
    h = gear(data)
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE)) == 0)
    strict = loose[(h[loose] >> np.uint32(32 - STRICT)) == 0]
    return (strict + 1).tolist(), (loose + 1).tolist()


def chunk_ends(begin: int, end: int, strict: list[int], loose: list[int]) -> list[int]:
    """Normalised boundaries of the text at begin ... end: the first strict
    border from LEAST to NORMAL, else the first loose one up to MOST, else
    MOST. The hash looks back 32 bytes at most, so borders of unchanged parts
    come back after an edit."""
    out, at = [], begin
    while end - at > LEAST:
        i = bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] < at + NORMAL:
            at = strict[i]
        else:
            i = bisect_left(loose, at + NORMAL)
            at = loose[i] if i < len(loose) and loose[i] <= at + MOST else at + MOST
        if at >= end:
            break
        out.append(at)
    if end > begin:
        out.append(end)
    return out


def fingerprints(data: np.ndarray, off: np.ndarray) -> list[str]:
    """The fingerprint of each text: its distinct chunks as sorted records of
    16 hex digits, 14 of the chunk's XXH64 and 2 of its length in bytes.

    Rows are hashed as one array; the hash of a text's first 31 bytes would
    look into the row before it, so each row stands behind 32 zero bytes.
    """
    n = len(off) - 1
    lens = np.diff(off)
    at = off[:-1] + 32 * np.arange(1, n + 1)
    room = np.zeros(len(data) + 32 * n, np.uint8)
    put = np.repeat(at - off[:-1], lens) + np.arange(len(data))
    room[put] = data
    strict, loose = borders(room)
    raw, digest = room.tobytes(), xxhash.xxh64_intdigest
    out = []
    for a, b in zip(at.tolist(), (at + lens).tolist()):
        s = a
        marks = set()
        i, j = bisect_left(strict, a), bisect_left(strict, b + 1)
        k, m = bisect_left(loose, a), bisect_left(loose, b + 1)
        for e in chunk_ends(a, b, strict[i:j], loose[k:m]):
            marks.add((digest(raw[s:e]) >> 8) << 8 | e - s)
            s = e
        out.append("".join(["%016x" % x for x in sorted(marks)]))
    return out


def marks(fp: str) -> dict[int, int]:
    """Chunk records of a fingerprint and their lengths."""
    return {(x := int(fp[i:i + 16], 16)): x & 255 for i in range(0, len(fp), 16)}


def likeness(a: str, b: str) -> float:
    """Containment: shared chunks' length over the shorter text's (two empty
    texts are alike, an empty one is unlike any other)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = np.frombuffer(bytes.fromhex(a), ">u8")
    y = np.frombuffer(bytes.fromhex(b), ">u8")
    both = np.intersect1d(x, y, assume_unique=True)
    return float((both & np.uint64(255)).sum() / min((x & np.uint64(255)).sum(), (y & np.uint64(255)).sum()))


def containment(a: str, b: str) -> float:
    """The share of a's length whose chunks b holds, too."""
    x, y = marks(a), marks(b)
    return sum(n for k, n in x.items() if k in y) / max(1, sum(x.values())) if x else float(not y)


def _edit(text: str, nxt: str) -> str:
    """The last third of the code points replaced by the first of the next text."""
    k = len(text) // 3
    return text[:len(text) - k] + nxt[:k]


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, doc_id, text): documents dealt by descending doc_id
    ranges; each bucket also gets the first row behind it as a guest, the last
    one the very first row. Texts move once, plus one row for each bucket.

    The order is doc_id descending, null ids last, then text descending.
    """
    ids = docs.select("doc_id")
    cuts = sorted(set(ids.stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 1 / (8 * buckets)))) if buckets > 1 else []
    # Buckets ascend as ids descend; at most ``buckets`` rows reach the driver.
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bounds, lambda c: c >= F.col("doc_id"))))
    rows = docs.withColumn("bucket", bucket.cast("int"))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    if not heads:
        return rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    before = {heads[(i + 1) % len(heads)]["bucket"]: h["bucket"] for i, h in enumerate(heads)}
    table = docs.sparkSession.createDataFrame([(h["bucket"], h["top"], before[h["bucket"]]) for h in heads], "b int, top long, host int")
    guests = rows.join(F.broadcast(table), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = guests.groupBy("host").agg(F.max(F.struct("doc_id", "text")).alias("k")).select(
        F.col("host").alias("bucket"), F.lit(True).alias("guest"), "k.doc_id", "k.text")
    return rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its last
    floor(n/3) code points replaced by the first as many, or all, of the next
    document by descending doc_id; after the last comes the first), and the
    likeness of its fingerprint to the edited text's and the next document's.

    Null texts count as empty (empty fingerprint); null ids come last, rows
    with one id are ordered by text; a single row is its own next; equal texts
    have equal fingerprints; an empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = id_text(docs, id_col, text_col)
    n = buckets or max(1, 2 * docs.rdd.getNumPartitions())
    rows = with_next(docs, n).repartition(F.col("bucket")).sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches):
        held: list = []  # rows whose next one has not come yet, or whose batch isn't full

        def out(group):
            own, nxt = [t for _, t, _ in group], [x for _, _, x in group]
            edited = [_edit(t, x) for t, x in zip(own, nxt)]
            chain = own[1:] == nxt[:-1]
            fp = fingerprints(*utf8(pa.array(own + edited + (nxt[-1:] if chain else nxt), pa.string())))
            k = len(own)
            a, e = fp[:k], fp[k:2 * k]
            b = fp[1:k] + fp[2 * k:] if chain else fp[2 * k:]
            return pa.RecordBatch.from_arrays([
                pa.array([d for d, _, _ in group], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(a), pa.array(e),
                pa.array([likeness(x, y) for x, y in zip(a, e)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(a, b)], pa.float64())],
                [c.split()[0] for c in SCHEMA.split(", ")])

        last, size = None, 0  # last: (bucket, doc_id, text) waiting for the next row
        for batch in batches:
            for bucket, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == bucket:
                    held.append((last[1], last[2], text))
                    size += len(last[2].encode())
                last = None if guest else (bucket, doc, text)
                if size > HELD or len(held) >= 2000:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)
        give_back()

    return rows.mapInArrow(run, SCHEMA)
