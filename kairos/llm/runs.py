"""Periodic runs of words: difference-cover LCE and a harmonic grid."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, prepare, utf8, words

#: A perfect difference set (fixed values): each residue modulo CYCLE but 0
#: is the difference of exactly one pair of COVER.
CYCLE, COVER = 13, (0, 1, 3, 9)
LEAST, TIMES = 6, 4  # a run has at least LEAST words and TIMES periods
CELLS = 1 << 18  # grid cells looked at in one pass
QUERIES = 1 << 19  # extension queries answered in one pass

_SLOT = np.full(CYCLE, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
#: _WAIT[r, d]: least k with r + k and r + d + k both in the cover.
_WAIT = np.array([[min(k for k in range(CYCLE) if _SLOT[(r + k) % CYCLE] >= 0 and _SLOT[(r + d + k) % CYCLE] >= 0)
                   for d in range(CYCLE)] for r in range(CYCLE)])


class Extension:
    """Longest common extensions to the right of any two places of ``seq``.

    Only suffixes at places of the difference cover are sorted: their first
    CYCLE words by one sort, then by doubling. Two places meet the cover
    together after fewer than CYCLE words, which are compared one by one; from
    there the answer is a range minimum over the neighbours' common prefixes.
    ``seq`` holds a value of its own behind each text, so no match leaves it.
    """

    def __init__(self, seq: np.ndarray):
        n, k = len(seq), len(COVER)
        # Values of their own behind the end: reads past it never match.
        self.seq = np.concatenate([seq, int(seq.max(initial=0)) + 1 + np.arange(2 * CYCLE)]).astype(np.uint32)
        cells = (n + CYCLE - 1) // CYCLE + 1
        at = (np.arange(cells)[:, None] * CYCLE + np.array(COVER)).ravel()
        at = at[at + CYCLE <= len(self.seq)]
        m = len(at)
        pairs = (self.seq[:-1].astype(np.uint64) << np.uint64(32)) | self.seq[1:]
        keys = [self.seq[at + CYCLE - 1]] + [pairs[at + i] for i in range(CYCLE - 3, -1, -2)]
        order = np.lexsort(keys)
        new = np.zeros(m, bool)
        for key in keys:
            s = key[order]
            new[1:] |= s[1:] != s[:-1]
        name = np.empty(m, np.int64)
        name[order] = np.cumsum(new)
        levels, step = [name], k
        while name.max(initial=0) + 1 < m and step < m:
            nxt = np.zeros(m, np.int64)
            nxt[:-step] = name[step:] + 1
            both = (name << 32) | nxt
            order = np.argsort(both, kind="stable")
            s = both[order]
            name = np.empty(m, np.int64)
            name[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            levels.append(name)
            step *= 2
        self.rank = name
        self.table = [self._neighbours(at, order, levels)]
        span = 1
        while 2 * span <= m - 1:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def _neighbours(self, at, order, levels):
        """Common prefix, in words, of each sorted suffix and the next one:
        whole blocks by the names of the doubling steps, then word by word."""
        m, k = len(at), len(COVER)
        a, b = order[:-1].copy(), order[1:].copy()
        for up in range(len(levels) - 1, -1, -1):
            both = (a < m) & (b < m)
            same = np.zeros(m - 1, bool)
            same[both] = levels[up][a[both]] == levels[up][b[both]]
            a[same] += k << up
            b[same] += k << up
        blocks = (a - order[:-1]) // k
        x, y = at[order[:-1]] + blocks * CYCLE, at[order[1:]] + blocks * CYCLE
        return (blocks * CYCLE + self._compare(x, y, np.full(m - 1, CYCLE))).astype(np.int32)

    def _compare(self, a, b, most):
        """How many words agree one by one, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero((most > 0) & (b < len(self.seq)) & (a < len(self.seq)))
        end = len(self.seq)
        for i in range(CYCLE):
            x, y = a[live] + i, b[live] + i
            fit = (x < end) & (y < end) & (most[live] > i)
            live, x, y = live[fit], x[fit], y[fit]
            live = live[self.seq[x] == self.seq[y]]
            if not len(live):
                break
            out[live] += 1
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b (a differs from b) to the right."""
        wait = _WAIT[a % CYCLE, (b - a) % CYCLE]
        out = self._compare(a, b, wait)
        on = np.flatnonzero(out == wait)
        x, y = a[on] + wait[on], b[on] + wait[on]
        i = self.rank[x // CYCLE * len(COVER) + _SLOT[x % CYCLE]]
        j = self.rank[y // CYCLE * len(COVER) + _SLOT[y % CYCLE]]
        lo, hi = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            pick = level == k
            row = self.table[k]
            out[on[pick]] += np.minimum(row[lo[pick]], row[hi[pick] - (1 << int(k))])
        return out


def _grid(seq: np.ndarray, starts: np.ndarray, lens: np.ndarray):
    """Places x and periods p with equal words at x, x + p, x + 2p and x + 3p,
    x on the grid of multiples of p. A run of TIMES periods holds four grid
    places in a row, so each run is met. Texts come by descending length."""
    p = 1
    while True:
        n = int(np.searchsorted(-lens, -max(LEAST, TIMES * p), side="right"))
        if not n:
            return
        end = int(starts[n - 1] + lens[n - 1])
        rows = end // p + 1
        ps = np.arange(p, p + max(1, min(CELLS // rows, int(lens[0]) // TIMES - p + 1)))
        at = np.arange(rows)[:, None] * ps
        word = seq[np.minimum(at, end)]
        same = word[1:] == word[:-1]
        hit = same[:-2] & same[1:-1] & same[2:] & (at[3:] < end)
        i, j = np.nonzero(hit)
        if len(i):
            yield at[i, j], ps[j]
        p = int(ps[-1]) + 1


def _joined(ids: list[np.ndarray], top: int):
    """The texts one after the other, longest first, a value of its own
    behind each: (sequence, starts, lengths, order)."""
    lens = np.array([len(x) for x in ids], np.int64)
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    seq = np.empty(int(lens.sum()) + len(lens), np.int64)
    for i, (o, s, n) in enumerate(zip(order, starts, lens)):
        seq[s:s + n] = ids[o]
        seq[s + n] = top + i
    return seq, starts, lens, order


def find(ids: list[np.ndarray], top: int) -> dict[int, list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each text, by start, then period.

    ``ids`` are the texts as word numbers below ``top``. A run is maximal and
    has its smallest period; length at least max(LEAST, TIMES * period).
    """
    seq, starts, lens, order = _joined(ids, top)
    found = list(_grid(seq, starts, lens)) if len(lens) else []
    if not found:
        return {}
    x, p = (np.concatenate(c) for c in zip(*found))
    doc = np.searchsorted(starts, x, side="right") - 1
    one = x + 3 * p < starts[doc] + lens[doc]  # the four words stand in one text
    x, p, doc = x[one], p[one], doc[one]
    if not len(x):
        return {}
    # Only texts with a candidate are sorted.
    some, doc = np.unique(doc, return_inverse=True)
    x = x - starts[some][doc]
    seq, starts, lens, back = _joined([ids[order[d]] for d in some], top)
    x = x + starts[doc]  # texts stay in order: they were sorted by length
    assert (back == np.arange(len(back))).all()
    order = order[some]
    right = Extension(seq)
    far = np.concatenate([right(x[i:i + QUERIES], (x + p)[i:i + QUERIES]) for i in range(0, len(x), QUERIES)])
    long = far > 2 * p
    x, p, doc, far = x[long], p[long], doc[long], far[long]
    if not len(x):
        return {}
    left = Extension(seq[::-1].copy())
    y = len(seq) - x  # the place before x, seen from the end
    inner = x > starts[doc]
    near = np.zeros(len(x), np.int64)
    for i in range(0, len(x), QUERIES):
        w = np.flatnonzero(inner[i:i + QUERIES]) + i
        near[w] = left(y[w] - p[w], y[w])
    begin, end = x - near, x + p + far
    ok = end - begin >= np.maximum(LEAST, TIMES * p)
    begin, end, p, doc = begin[ok], end[ok], p[ok], doc[ok]
    # A stretch met with several periods has the smallest as its period.
    by = np.lexsort((p, end, begin))
    begin, end, p, doc = begin[by], end[by], p[by], doc[by]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    out: dict = {}
    for d, b, e, q in zip(doc[first], begin[first], end[first], p[first]):
        out.setdefault(int(order[d]), []).append((int(b - starts[d]), int(e - b), int(q)))
    return {d: sorted(r, key=lambda t: (t[0], t[2])) for d, r in out.items()}


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that no run holds behind its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:-1]) == 0)


def repeat_tail(doc_id: int | None, n: int) -> np.ndarray:
    """Original number of each word after the planted repetition: where the
    id's crc32 is a multiple of 10, words from a on repeat a stretch of p."""
    src = np.arange(n)
    if doc_id is None or not n:
        return src
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        src[a:] = a + np.arange(n - a) % p
    return src


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each word, equal for equal words, and a bound of them."""
    if not len(starts):
        return np.zeros(0, np.int64), 1
    # Words and the gaps between them are the pieces of one binary array.
    offsets = np.stack([starts, ends], 1).ravel().astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)[::2].astype(np.int64), len(coded.dictionary) + 1


def _sha(data: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """Digest of the words joined by one space, some words at a time."""
    h, gap = hashlib.sha256(), b""
    for i in range(0, len(starts), 1 << 16):
        h.update(gap + b" ".join([data[a:b] for a, b in zip(starts[i:i + (1 << 16)].tolist(), ends[i:i + (1 << 16)].tolist())]))
        gap = b" "
    return h.hexdigest()


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of the words of every whole text after ``repeat_tail``, and the
    text with each run cut to its first period, as digests.

    A null text has no word: no run, the digests of the empty string. A null id
    leaves its text as it is. Rows that repeat give equal rows; of longest runs
    the first, then the one with the smallest period; an empty table gives an
    empty result; other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = utf8(batch.column(1))
            a, b, first = words(data, off)
            number, top = _numbers(data, a, b)
            src = [repeat_tail(d, int(j - i)) + i for d, i, j in zip(ids, first[:-1], first[1:])]
            runs = find([number[s] for s in src], top)
            raw, cols = data.tobytes(), [[] for _ in range(8)]
            for i, (doc, s) in enumerate(zip(ids, src)):
                own = runs.get(i, [])
                best = min(own, key=lambda t: (-t[1], t[0], t[2]), default=(None, None, None))
                keep = s[kept(len(s), own)] if own else s
                text = "".join("%d,%d,%d\n" % t for t in own)
                row = (doc, len(own), *best, 1000 * best[1] // best[2] if own else None,
                       hashlib.sha256(text.encode()).hexdigest(), _sha(raw, a[keep], b[keep]))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def collapse(texts: list[str]) -> list[str]:
    """Each text's words with every run cut to its first period, one space
    between them: the operator on plain texts."""
    data, off = utf8(pa.array(texts, pa.string()))
    a, b, first = words(data, off)
    number, top = _numbers(data, a, b)
    parts = [np.arange(i, j) for i, j in zip(first[:-1], first[1:])]
    runs = find([number[s] for s in parts], top)
    raw, out = data.tobytes(), []
    for i, s in enumerate(parts):
        keep = s[kept(len(s), runs.get(i, []))]
        out.append(b" ".join([raw[x:y] for x, y in zip(a[keep].tolist(), b[keep].tolist())]).decode())
    return out
