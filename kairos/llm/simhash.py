"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import lower_spaced, free_name, placed, prepare, stage, utf8, words
from .components import components

BUCKET = 2048  # a larger bucket is split, first by more bits, then into blocks


def text_fingerprints(arr: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of every text of an Arrow string array."""
    data, off = utf8(arr)
    starts, ends, first = words(data, off)
    norm, ws, we = lower_spaced(data, starts, ends)
    n_words = np.diff(first)
    n_sh = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    doc = np.repeat(np.arange(len(n_sh)), n_sh)
    at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    to = np.minimum(at + shingle, first[1:][doc]) - 1
    counts = np.zeros((len(n_sh), 64), np.int64)
    step, digest = 1 << 17, xxhash.xxh64_intdigest
    for lo in range(0, len(at), step):
        a, b, d = ws[at[lo:lo + step]].tolist(), we[to[lo:lo + step]].tolist(), doc[lo:lo + step]
        h = np.fromiter((digest(norm[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.concatenate(([0], np.flatnonzero(np.diff(d)) + 1))
        counts[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n_sh[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, text_col: str = "text", key: str = "doc_id", shingle: int = 4) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) of every row."""
    prepare(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("key"), _fp(F.col(text_col).cast("string"), shingle).alias("fp"))


def _fp(text, shingle: int):
    @arrow_udf("long")
    def run(t: pa.Array) -> pa.Array:
        return pa.array(text_fingerprints(t, shingle).view(np.int64))

    return run(text)


# -- bit-sliced comparison ---------------------------------------------------

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of packed words: bit i of plane b is bit b of fingerprint i."""
    n = -(-len(fps) // 64) * 64 + 64  # one word more, so that planes can be shifted
    rows = np.zeros(n, np.uint64)
    rows[:len(fps)] = fps
    bits = np.unpackbits(rows.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a, b, c):
    """Carry-save adder: sum and carry of three planes."""
    t = a ^ b
    return t ^ c, (a & b) | (t & c)


def near_offsets(planes: np.ndarray, valid: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Rows i with valid bit i whose fingerprint and that of row i + d differ
    in at most ``radius`` bits.

    Distances of all rows are counted at once: eight difference planes go
    through a tree of carry-save adders into counter planes; after each
    eight, words of 64 rows of which all exceed the radius are abandoned.
    """
    q, r = d >> 6, d & 63
    live = np.flatnonzero(valid)
    zero = np.zeros(len(live), np.uint64)
    count = [zero.copy() for _ in range(max(3, radius.bit_length()))]  # planes of 1, 2, 4, ...
    over = zero.copy()  # beyond what the planes count
    alive = valid[live]
    width = planes.shape[1]
    for p in range(0, 64, 8):
        x = planes[p:p + 8]
        near = x[:, np.minimum(live + q, width - 1)]
        if r:
            far = x[:, np.minimum(live + q + 1, width - 1)]
            near = (near >> np.uint64(r)) | (far << np.uint64(64 - r))
        e = x[:, live] ^ near
        s1, c1 = _add(e[0], e[1], e[2])
        s2, c2 = _add(e[3], e[4], e[5])
        s3, c3 = _add(e[6], e[7], s1)
        count[0], c4 = _add(count[0], s2, s3)
        t1, f1 = _add(c1, c2, c3)
        count[1], f2 = _add(count[1], c4, t1)
        count[2], carry = _add(count[2], f1, f2)
        for k in range(3, len(count)):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        more, same = zero[:len(live)].copy(), ~zero[:len(live)]  # count > radius, from the highest plane down
        for k in range(len(count) - 1, -1, -1):
            if radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        alive &= ~(more | over)
        left = np.flatnonzero(alive)
        if len(left) < len(live):
            live, alive, over, count = live[left], alive[left], over[left], [c[left] for c in count]
        if not len(live):
            break
    if not len(live):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return live[at] * 64 + bit


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints that share a key and differ in at
    most ``radius`` bits: (fingerprint, root), never all pairs.

    Rows of one key lie together; row i is compared with row i + d for
    d = 1, 2, ... over all keys at once, with fewer rows as keys run out.
    """
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    size = np.diff(cut)
    left = np.repeat(cut[1:], size) - np.arange(len(keys))  # rows of the key from here on
    total = np.repeat(size, size)
    rows = np.flatnonzero(total > 1)
    root = np.arange(len(keys))
    d, planes, have = 1, None, 0
    while len(rows):
        if planes is None or len(rows) * 2 < have:
            planes, have, at, rest = bit_planes(fps[rows]), len(rows), rows, left[rows]
        mask = np.zeros(planes.shape[1] * 64, np.uint8)
        mask[:len(at)] = rest > d
        hit = near_offsets(planes, np.packbits(mask, bitorder="little").view(np.uint64), d, radius)
        a, b = at[hit], at[hit] + d
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
        if apart.any():
            while not np.array_equal(nxt := root[root], root):
                root = nxt
        d += 1
        rows = rows[total[rows] > d]
    linked = np.flatnonzero(root != np.arange(len(root)))
    return fps[linked], fps[root[linked]]


def _links(batches, radius: int, rows: int = 1 << 19):
    """Links of the key-sorted rows of a partition, a few whole keys at a time."""
    held: list = []

    def out(k, f):
        u, v = bucket_links(k, f.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(k) for k, _ in held) >= rows:
            k, f = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
            if cut:
                yield out(k[:cut], f[:cut])
            held = [(k[cut:], f[cut:])]
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def _piece(fp, widths, i):
    shift = sum(widths[:i])
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << widths[i]) - 1))


def _widths(bits: int, n: int) -> list[int]:
    return [bits // n + (i < bits % n) for i in range(n)]


def _hot(keyed: DataFrame, name: str):
    hot = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET), name)
    n = hot.count()
    if not n:
        return None
    # Broadcast only below a counted bound; beyond it the planner joins by shuffle.
    return F.broadcast(hot) if n <= 100_000 else hot


def _split(keyed: DataFrame, hot: DataFrame, tag: str):
    return keyed.join(hot.select("key"), "key", "left_anti"), keyed.join(hot, "key")


def buckets(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp): fingerprints that differ in at most ``radius`` bits share a key.

    Of radius + 2 pieces of the 64 bits at least two are equal, so each pair
    of pieces makes a key. A key with over ``BUCKET`` distinct fingerprints is
    split by one more piece: the bits outside its two pieces make radius + 1
    finer ones, of which one is equal. What is still too large is dealt into
    hashed blocks, each pair of blocks being a key. Nothing is dropped.
    """
    widths = _widths(64, radius + 2)
    pairs = list(combinations(range(radius + 2), 2))
    f = F.col("fp")
    keyed = fps.select(f, F.posexplode(F.array(*[
        F.shiftleft(_piece(f, widths, i), widths[j]).bitwiseOR(_piece(f, widths, j)) for i, j in pairs])).alias("p", "bits"))
    keyed = keyed.select(F.xxhash64(F.lit(1), "p", "bits").alias("key"), "fp", "p")
    hot = _hot(keyed, "hot-keys")
    if hot is None:
        return keyed.select("key", "fp")
    cold, rows = _split(keyed, hot, "a")
    # The bits outside the key's two pieces, cut finer.
    fine = []
    for i, j in pairs:
        own = [b for k in range(radius + 2) if k not in (i, j) for b in range(sum(widths[:k]), sum(widths[:k + 1]))]
        cuts = np.cumsum([0, *_widths(len(own), radius + 1)])
        masks = [sum(1 << b for b in own[cuts[k]:cuts[k + 1]]) for k in range(radius + 1)]
        fine.append(F.array(*[f.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks]))
    finer = rows.select("key", "fp", F.posexplode(F.element_at(F.array(*fine), F.col("p") + 1)).alias("k", "bits"))
    finer = finer.select(F.xxhash64(F.lit(2), "key", "k", "bits").alias("key"), "fp")
    out = cold.select("key", "fp")
    hot = _hot(finer, "hot-finer")
    if hot is None:
        return out.unionByName(finer)
    cold, rows = _split(finer, hot, "b")
    blocks = F.ceil(F.col("n") / F.lit(BUCKET)).cast("int")
    rows = rows.withColumn("nb", blocks).withColumn("i", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("nb")).cast("int"))
    rows = rows.select("key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    rows = rows.select(F.xxhash64(F.lit(3), "key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
    return out.unionByName(cold.select("key", "fp")).unionByName(rows)


def link_groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root) of every fingerprint of ``prints`` that links to another one."""
    fps = stage(prints.select("fp").distinct(), "fps")
    keyed = buckets(fps, radius).repartition("key").sortWithinPartitions("key")
    links = keyed.mapInArrow(lambda it: _links(it, radius), "u long, v long").distinct()
    return components(links).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Lower-cased (A-Z) words, ``shingle``-word shingles with repeats, XXH64
    (seed 42); a bit is set if set in over half the hashes. Rows whose
    fingerprints differ in at most ``radius`` bits link; the component's id is
    the smallest doc_id reachable. Null and empty texts have fingerprint zero
    and link like others; repeated rows and repeated ids are rows of their
    own; null ids count last (a component of null ids alone has a null id).
    An empty table gives an empty result; other columns are not read.
    """
    prints = stage(fingerprints(docs, text_col, id_col, shingle), "simhash")
    roots = link_groups(prints, radius)
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    linked = stage(roots.join(least, "fp"), "linked")
    ids = linked.join(linked.groupBy("root").agg(F.min("least").alias("cid")), "root").select("fp", "cid")
    each = least.join(ids, "fp", "left").select("fp", F.coalesce("cid", "least").alias("component_id"))
    return prints.join(each, "fp").select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                          "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate component (smallest
    doc_id, null ids last; of repeated rows the first), columns unchanged,
    whatever their names."""
    place = free_name(docs, "__loc")
    docs = placed(docs, place)
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(place).alias("loc"), F.col(text_col).cast("string").alias("text"))
    prints = stage(rows.select("id", "loc", _fp(F.col("text"), shingle).alias("fp")), "simhash")
    roots = link_groups(prints, radius)
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "loc"))
    least = stage(prints.groupBy("fp").agg(first.alias("k")).join(roots, "fp", "left").select(
        F.coalesce("root", "fp").alias("root"), "k"), "least")
    keep = least.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.loc").alias("keep"))
    gone = stage(prints.join(keep, prints["loc"] == keep["keep"], "left_anti").select(F.col("loc").alias(place)), "dropped")
    return docs.join(gone, place, "left_anti").drop(place)
