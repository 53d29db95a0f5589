"""Token files coded by a static range asymmetric numeral system (rANS).

A file is one row of ``part, seq, ..., payload``; its payload holds the ids of
whole documents in ascending doc_id order as independent blocks:

    8 bytes   b"RANSTOK1"
    uint32 x4 lanes, steps (ids of a block / lanes), blocks, words
    uint64    ids in the file
    uint32 x (blocks + 1)      checkpoints: first word of each block
    uint32 x blocks            crc32 of each block's words
    uint64 x (blocks * lanes)  state of each lane at the block's start
    uint32 x words             renormalisation words, blocks one after another

All integers are little-endian. Id number i of a block belongs to lane
i mod lanes. A state lies in [2^31, 2^63); frequencies add up to 2^SCALE. The
decoder takes, in every step, one word for each lane that falls below 2^31, in
lane order. Blocks share one frequency table and can be decoded alone from
their checkpoint, all at once here. The last block is filled up with the most
frequent id.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _ranges, byte_chars, distinct, tokenizer_path, utf8_bytes
from .common import _SPACE, by_bytes, give_back, id_text, prepare, stage, stage_path, utf8, words

MAGIC = b"RANSTOK1"
LANES, STEPS = 16, 512
SCALE = 18
STARTS = 200_000  # files' places are broadcast up to so many counted rows
LOW = np.uint64(1 << 31)
FILE_IDS = 1 << 19  # a file ends with the document that reaches so many ids


# -- coding ------------------------------------------------------------------

def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to add up to 2^scale; every used id keeps at least 1."""
    counts = np.asarray(counts, np.int64)
    total, used = int(counts.sum()), counts > 0
    size = 1 << scale
    if not total:
        return np.zeros_like(counts)
    if used.sum() > size:
        raise ValueError("more distinct ids than the scale can hold")
    f = np.where(used, np.maximum(1, (counts.astype(np.float64) * (size / total)).astype(np.int64)), 0)
    gap = size - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if gap > 0:
        f[order[0]] += gap
    for i in order.tolist():  # too much given to rare ids: taken from frequent ones
        if gap >= 0:
            break
        take = min(int(f[i]) - 1, max(1, -gap * int(f[i]) // size + 1), -gap) if f[i] > 1 else 0
        f[i] -= take
        gap += take
    while gap < 0:
        i = int(f.argmax())
        f[i] -= 1
        gap += 1
    return f


class Table:
    """Shared coding table of the ids' frequencies."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq = np.asarray(freq, np.uint64)
        self.scale = scale
        self.start = np.concatenate(([0], np.cumsum(self.freq)))[:-1].astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        self.fill = int(self.freq.argmax()) if len(self.freq) else 0


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """The payload of one file."""
    ids = np.asarray(ids, np.int64)
    n, per = len(ids), lanes * steps
    blocks = -(-n // per)
    full = np.full(blocks * per, table.fill, np.int64)
    full[:n] = ids
    rows = full.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, blocks * lanes)
    state = np.full(blocks * lanes, LOW, np.uint64)
    out = np.zeros((steps, blocks * lanes), np.uint32)
    put = np.zeros((steps, blocks * lanes), bool)
    scale = np.uint64(table.scale)
    for t in range(steps - 1, -1, -1):
        f, s = table.freq[rows[t]], table.start[rows[t]]
        over = state >= f << np.uint64(63 - table.scale)
        put[t], out[t] = over, state.astype(np.uint32)
        state = np.where(over, state >> np.uint64(32), state)
        q = state // f
        state = (q << scale) + (state - q * f) + s
    words_ = out.reshape(steps, blocks, lanes).transpose(1, 0, 2)
    mask = put.reshape(steps, blocks, lanes).transpose(1, 0, 2)
    flat = words_[mask].astype("<u4")
    at = np.concatenate(([0], np.cumsum(mask.sum(axis=(1, 2))))).astype("<u4")
    raw = flat.tobytes()
    crc = np.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], "<u4")
    return b"".join([MAGIC, struct.pack("<4IQ", lanes, steps, blocks, len(flat), n), at.tobytes(), crc.tobytes(), state.astype("<u8").tobytes(), raw])


def decode(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first ... last - 1 (all of them by default), decoded
    side by side from their checkpoints after their checksums are tested."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token file")
    lanes, steps, blocks, n_words, n = struct.unpack_from("<4IQ", payload, 8)
    pos = 32
    at = np.frombuffer(payload, "<u4", blocks + 1, pos).astype(np.int64)
    crc = np.frombuffer(payload, "<u4", blocks, pos + 4 * (blocks + 1))
    pos += 4 * (2 * blocks + 1)
    state = np.frombuffer(payload, "<u8", blocks * lanes, pos).astype(np.uint64).reshape(blocks, lanes)
    pos += 8 * blocks * lanes
    if len(payload) < pos + 4 * n_words:
        raise ValueError("the file is cut short")
    last = blocks if last is None else min(last, blocks)
    for b in range(first, last):
        if zlib.crc32(payload[pos + 4 * at[b]:pos + 4 * at[b + 1]]) != crc[b]:
            raise ValueError(f"block {b} is damaged")
    words_ = np.concatenate([np.frombuffer(payload, "<u4", n_words, pos), np.zeros(1, "<u4")]).astype(np.uint64)
    state, ptr = state[first:last].copy(), at[first:last].copy()
    out = np.zeros((steps, last - first, lanes), np.int64)
    mask, scale = np.uint64((1 << table.scale) - 1), np.uint64(table.scale)
    for t in range(steps):
        low = state & mask
        sym = table.slot[low.astype(np.int64)]
        out[t] = sym
        state = table.freq[sym] * (state >> scale) + low - table.start[sym]
        need = state < LOW
        rank = np.cumsum(need, axis=1)
        word = words_[np.minimum(ptr[:, None] + rank - 1, n_words)]
        state = np.where(need, state << np.uint64(32) | word, state)
        ptr += rank[:, -1]
    ids = out.transpose(1, 0, 2).reshape(-1)
    return ids[:max(0, min(n, last * lanes * steps) - first * lanes * steps)]


# -- tokens of a batch, by the tokenizers library ------------------------------

class WordEncoder:
    """The library's ids of whole texts, put together from those of their
    white-space words: this vocabulary drops white space before cutting
    pieces, so no piece crosses it. ``check`` raises for tokenizers that
    don't. Words of Latin-1 letters go straight to the library's BPE model,
    all others through its whole ``encode``; ids of known words are held in a
    bounded table."""

    HELD = 1_000_000  # words; some 40 bytes each

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.check()
        self.clear()

    def check(self) -> None:
        probe = ["Don't STOP,\nÉté  2024!", "a\t b\r\nc", "Ünï x1y2 ''s", " <|endoftext|> z."]
        for p in probe:
            parts = [i for w in p.split() for i in self._whole([w])[0]]
            if parts != self._whole([p])[0]:
                raise ValueError("this tokenizer's pieces cross white space")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.end = Grown(np.uint32), Grown(np.int64)
        self.end.add(np.zeros(1, np.int64))

    def _latin(self, word: bytes) -> list[int] | None:
        """Ids of a word of Latin-1 letters, already lower-cased; such words
        are one piece, written in the vocabulary's byte characters."""
        if not word.isalpha():  # ASCII letters are their own byte characters
            text = word.decode()
            if not text.isalpha() or max(text) > "\xff":
                return None
            return [t.id for t in self.tok.model.tokenize(word.decode("latin-1").translate(_BYTE_CHARS))]
        return [t.id for t in self.tok.model.tokenize(word.decode())]

    def _learn(self, missing: pa.Array) -> None:
        names = missing.to_pylist()
        rows = [self._latin(w) if self.suffix else None for w in names]
        slow = [i for i, r in enumerate(rows) if r is None]
        for i, ids in zip(slow, self._whole([names[i].decode() for i in slow])):
            rows[i] = ids
        ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        self.end.add(self.flat.size + ends)
        self.flat.add(np.fromiter(chain.from_iterable(rows), np.uint32, int(ends[-1])))
        self.known = pa.concat_arrays([self.known, missing])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each."""
        raw, cut, first = cut_words(data, off)
        if len(cut) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        word, back = distinct(raw, cut)
        found = pc.index_in(word, self.known)
        if found.null_count and len(self.known) + found.null_count > self.HELD:
            self.clear()
            found = pc.index_in(word, self.known)
        new = np.asarray(found.is_null())
        at = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            at[new] = len(self.known) + np.arange(new.sum())
            self._learn(word.filter(pa.array(new)))
        end = self.end.view()
        start, n = end[at], end[at + 1] - end[at]
        count = n[back]
        ids = self.flat.view()[_ranges(start[back], count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(ends[first])


class Grown:
    """An array that grows by doubling; ``view`` copies nothing."""

    def __init__(self, kind):
        self.room, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.size + len(values)), self.room.dtype)
            room[:self.size] = self.room[:self.size]
            self.room = room
        self.room[self.size:self.size + len(values)] = values
        self.size += len(values)

    def view(self) -> np.ndarray:
        return self.room[:self.size]


_BYTE_CHARS = {b: c for c, b in byte_chars().items()}


def cut_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words without white space: their bytes, offsets, and the
    number of the first word of each row (n + 1). Latin-1 capitals become small
    letters, and marks at a word's end behind a Latin letter or digit become
    a word of their own, so that there are fewer different words; a word with
    ``<|``, which may begin a special token, stays as it is."""
    s, e, first = words(data, off)
    solid = ~_SPACE[data]
    raw = data[solid]
    at = np.concatenate(([0], np.cumsum(e - s)))
    special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)) + 1
    low[lead[raw[lead] <= 0x9E]] += 32
    plain = (low >= 97) & (low <= 122) | (low >= 48) & (low <= 57)
    plain[lead] = True
    mark = np.zeros(256, bool)
    mark[[33, 44, 46, 58, 59, 63]] = True
    is_mark = mark[low]
    # The last byte of each word that is no mark.
    last = np.maximum.accumulate(np.where(is_mark, np.int32(-1), np.arange(len(low), dtype=np.int32))) if len(low) else np.zeros(0, np.int32)
    body = last[at[1:] - 1].astype(np.int64) + 1 if len(s) else np.zeros(0, np.int64)
    split = (body > at[:-1]) & (body < at[1:]) & plain[np.maximum(body - 1, 0)] if len(s) else np.zeros(0, bool)
    for w in np.unique(np.searchsorted(at, special, side="right") - 1).tolist():
        low[at[w]:at[w + 1]] = raw[at[w]:at[w + 1]]
        split[w] = False
    cut = np.sort(np.concatenate([at, body[split]]))
    return low, cut, np.searchsorted(cut, at[first])


_ENCODERS: dict = {}


def _encoder(spec: str) -> WordEncoder:
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = WordEncoder(spec)
    return _ENCODERS[spec]


# -- jobs --------------------------------------------------------------------

def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, part, at, ids) sorted by doc_id: part numbers ascend with
    doc_id, ``at`` counts the rows of a part; ids are little-endian uint32."""
    spark = docs.sparkSession
    prepare(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # the vocabulary file

    def run(batches):
        from pyspark import TaskContext
        enc, part, at = _encoder(spec.value), TaskContext.get().partitionId(), 0
        for b in (part for whole in batches for part in by_bytes(whole, 1, 4 << 20)):
            data, off = utf8(b.column(1))
            ids, n = enc.encode(data, off)
            ends = np.cumsum(n)
            end = np.array([end_id], "<u4").tobytes()
            raw = [ids[e - k:e].astype("<u4").tobytes() + end for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([part] * b.num_rows, pa.int64()), pa.array(range(at, at + b.num_rows), pa.int64()), pa.array(raw, pa.binary())],
                ["doc_id", "part", "at", "ids"])
            at += b.num_rows
        give_back()

    n = docs.rdd.getNumPartitions()
    return docs.repartitionByRange(max(n, 1), F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).mapInArrow(run, "doc_id long, part long, at long, ids binary")


def count_ids(rows: DataFrame) -> np.ndarray:
    """How often each id occurs; one row for each id reaches the driver."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(utf8_bytes(b.column(0).cast(pa.large_binary()))[0].tobytes(), "<u4")
            c = np.bincount(ids, minlength=len(total))
            c[:len(total)] += total
            total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    got = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def write_files(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Encode every text and write the token files ``out/files`` and the
    shared frequency table ``out/table``.

    Documents are range-partitioned by doc_id (texts move once); ids are
    staged, counted, then coded in the order they were staged in. File names
    are (part, first row), in ascending doc_id order; ``start`` is the number of ids
    in earlier files.
    """
    spark = docs.sparkSession
    staged = stage(tokenize(id_text(docs, id_col, text_col), path or tokenizer_path("word_bpe_49k.json"), end_id), "token-ids")
    freq = frequencies(count_ids(staged))
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], "id long, freq long").coalesce(1).write.parquet(f"{out}/table")
    table = spark.sparkContext.broadcast(Table(freq))

    def run(batches):
        part, first, docs_, raw, held = None, 0, [], [], 0

        def close():
            lens = [len(r) // 4 for r in raw]
            ids = np.frombuffer(b"".join(raw), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([docs_], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([encode(ids, table.value)], pa.binary())],
                ["part", "seq", "n_ids", "doc_ids", "lengths", "payload"])

        for b in batches:
            for p, at, d, r in zip(*(c.to_pylist() for c in b.columns)):
                if raw and (p != part or at != first + len(raw) or held >= FILE_IDS):
                    yield close()
                    docs_, raw, held = [], [], 0
                if not raw:
                    part, first = p, at
                docs_.append(d)
                raw.append(r)
                held += len(r) // 4
        if raw:
            yield close()

    # A scan gives the rows of each staged file, or of a part of it, in their
    # order, and files are named by their first row: no shuffle is needed.
    rows = staged.select("part", "at", "doc_id", "ids")
    files = rows.mapInArrow(run, "part long, seq long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary")
    files.write.option("compression", "none").parquet(f"{out}/files")


def read_table(spark: SparkSession, out: str) -> Table:
    rows = spark.read.parquet(f"{out}/table").collect()  # one row for each used id
    freq = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return Table(freq)


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read from the files."""
    table = spark.sparkContext.broadcast(read_table(spark, out))
    files = spark.read.parquet(f"{out}/files")
    # One row for each part, then one for each file of a part: file sizes only.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p"), before.alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "seq", "n_ids").withColumn("inside", inside).join(F.broadcast(parts), F.col("part") == F.col("p")).select(
        F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("inside")).alias("start"))

    def run(batches):
        for b in batches:
            for start, docs_, lens, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = decode(payload, table.value).astype("<u4")
                ends = np.cumsum(lens)
                for lo in range(0, len(docs_), 4096):
                    sel = range(lo, min(lo + 4096, len(docs_)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([docs_[i] for i in sel], pa.int64()), pa.array([start + int(ends[i]) - lens[i] for i in sel], pa.int64()),
                         pa.array([lens[i] for i in sel], pa.int64()), pa.array([ids[ends[i] - lens[i]:ends[i]].tobytes() for i in sel], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    prepare(spark)
    if starts.count() <= STARTS:
        starts = F.broadcast(starts)
    rows = files.join(starts, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("start", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from token files
    written in ascending doc_id order and read back.

    A null or empty text is the end id alone; null ids come last, repeated
    ids in a fixed order of their texts; an empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    out = stage_path(spark, "tokens")
    write_files(docs, out, path, id_col, text_col, end_id)
    return read_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
