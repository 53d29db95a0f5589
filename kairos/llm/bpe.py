"""Byte-level BPE: speculate with greedy longest match, verify, repair.

Greedy longest match proposes tokens for every distinct word of a batch. A
token sequence is the BPE result exactly if every adjacent pair of tokens is
compatible, that is, if no merge across their border would have come before
the merges that built the two; that is tested for all pairs at once. Only
words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back, prepare, utf8

NEVER = 1 << 30  # the rank of a pair that has no merge
WIDE = 64  # words of more bytes are proposed for and, if need be, merged one at a time
BLOCK = 1 << 16  # positions of such a word that are matched together

# The pre-tokenizer's pattern, with \s spelled out as Unicode white space.
_WS = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files:
    visible Latin-1 characters stand for themselves, the other bytes for the
    characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of all runs (start, length), one run after the other."""
    total = int(lens.sum())
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


class Bpe:
    """Tables of a byte-level BPE vocabulary, built once on the driver and
    broadcast (their size is that of the vocabulary file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        special = set(self.special.values())
        n = max([*vocab.values(), *special]) + 1
        self.text = [b""] * n
        for s, i in vocab.items():
            self.text[i] = raw(s) if i not in special else s.encode()
        for s, i in self.special.items():
            self.text[i] = s
        by = {t: i for i, t in enumerate(self.text) if i not in special}
        self.byte_id = np.array([by[bytes([b])] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.n = n
        key = left * n + right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.pair_made = key[order], order.astype(np.int64), made[order]
        rank_of = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in reversed(list(enumerate(zip(left, right, made))))}
        self.rank_of = rank_of
        # How each token is built: the first merge that gives it.
        self.rank = np.full(n, -1, np.int64)
        split = {}
        for r, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist())):
            if c not in split:
                split[c] = (a, b)
                self.rank[c] = r
        self.right_spine, self.right_rank = self._spines(split, 1)
        self.left_spine, self.left_rank = self._spines(split, 0)
        self.text_len = np.array([len(t) for t in self.text], np.int64)
        self.text_at = np.concatenate(([0], np.cumsum(self.text_len)))
        self.text_all = np.frombuffer(b"".join(self.text), np.uint8)
        # Greedy match proposes only tokens that BPE itself makes of their bytes.
        good = [i for i in range(n) if i not in special and self.text[i] and (len(self.text[i]) == 1 or self.merge(self.text[i]) == [i])]
        self._trie(good)

    def _spines(self, split, side):
        """For each token its outer parts on one side, from the byte up to
        itself, and the rank of the merge that makes the next one."""
        rows = []
        for i in range(self.n):
            row = [i]
            while row[-1] in split:
                row.append(split[row[-1]][side])
            rows.append(row[::-1])
        depth = max(map(len, rows))
        spine, up = np.full((self.n, depth), -1, np.int32), np.full((self.n, depth), NEVER, np.int32)
        for i, row in enumerate(rows):
            spine[i, :len(row)] = row
            up[i, :len(row) - 1] = self.rank[row[1:]]
        return spine, up

    def _trie(self, tokens):
        step, accept, nodes = {}, [-1], 1
        for i in tokens:
            at = 0
            for b in self.text[i]:
                k = at * 256 + b
                if k not in step:
                    step[k] = nodes
                    nodes += 1
                    accept.append(-1)
                at = step[k]
            accept[at] = i
        keys = np.array(sorted(step), np.int64)
        self.step_key, self.step_to = keys, np.array([step[k] for k in keys.tolist()], np.int64)
        self.accept = np.array(accept, np.int64)

    # -- one word ------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word: a heap of ranked pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank_of[a, b][1], -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                if x >= 0 and nxt[x] >= 0 and (r := self.rank_of.get((ids[x], ids[nxt[x]]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[nxt[x]]))
        return [i for i in ids if i >= 0]

    # -- many words ----------------------------------------------------------

    def pair_lookup(self, a, b):
        """Rank and result of merging a and b; NEVER where there is none."""
        k = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.pair_key, k), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == k) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between tokens a and b: the outer
        parts at the border grow in rank order, and no merge across it may
        come before the next one of either side."""
        ok = np.ones(len(a), bool)
        i, j, live = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            x, y, p, q = a[live], b[live], i[live], j[live]
            across, _ = self.pair_lookup(self.right_spine[x, p], self.left_spine[y, q])
            up_x, up_y = self.right_rank[x, p], self.left_rank[y, q]
            bad = (across < up_x) & (across <= up_y)
            ok[live[bad]] = False
            go = ~bad & ((up_x < NEVER) | (up_y < NEVER))
            first = up_x <= up_y
            i[live[go & first]] += 1
            j[live[go & ~first]] += 1
            live = live[go]
        return ok

    def greedy(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words: (word, token) in order."""
        word, pos, out = np.arange(len(start)), start.copy(), []
        while len(word):
            node, cur, best, best_end = np.zeros(len(word), np.int64), pos.copy(), np.full(len(word), -1, np.int64), pos.copy()
            live = np.arange(len(word))
            while len(live):
                k = node[live] * 256 + data[cur[live]]
                at = np.minimum(np.searchsorted(self.step_key, k), len(self.step_key) - 1)
                hit = self.step_key[at] == k
                live, to = live[hit], self.step_to[at[hit]]
                node[live] = to
                cur[live] += 1
                token = self.accept[to]
                took = live[token >= 0]
                best[took], best_end[took] = token[token >= 0], cur[took]
                live = live[cur[live] < end[word[live]]]
            out.append((word, best))
            pos = best_end
            more = pos < end[word]
            word, pos = word[more], pos[more]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, t = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def greedy_wide(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``greedy`` for words of any length: the longest match at every
        position of a block, then hops from token to token."""
        words_, toks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w, (lo, hi) in enumerate(zip(start.tolist(), end.tolist())):
            at = lo
            while at < hi:
                first, stop = at, min(hi, at + BLOCK)
                best, size = np.full(stop - first, -1, np.int64), np.ones(stop - first, np.int64)
                node, live, depth = np.zeros(stop - first, np.int64), np.arange(stop - first), 0
                while len(live):
                    k = node[live] * 256 + data[first + live + depth]
                    found = np.minimum(np.searchsorted(self.step_key, k), len(self.step_key) - 1)
                    hit = self.step_key[found] == k
                    live, to = live[hit], self.step_to[found[hit]]
                    node[live] = to
                    depth += 1
                    token = self.accept[to]
                    took = live[token >= 0]
                    best[took], size[took] = token[token >= 0], depth
                    live = live[first + live + depth < hi]
                hops, step = [], size.tolist()
                while at < stop:
                    hops.append(at - first)
                    at += step[at - first]
                toks.append(best[hops])
                words_.append(np.full(len(hops), w, np.int64))
        return np.concatenate(words_), np.concatenate(toks)

    def merge_many(self, data, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of words of at most ``WIDE`` bytes, all at once: in each
        step every word merges its lowest, leftmost pair."""
        words_, toks = [], []
        lens = end - start
        for lo, hi in ((0, 8), (8, 16), (16, 32), (32, WIDE)):
            rows = np.flatnonzero((lens > lo) & (lens <= hi))
            for part in np.array_split(rows, max(1, -(-len(rows) * hi // (1 << 20)))):
                if not len(part):
                    continue
                cols = np.arange(hi)
                inside = cols < lens[part][:, None]
                ids = np.where(inside, self.byte_id[data[np.minimum(start[part][:, None] + cols, len(data) - 1)]], -1)
                rank = np.full(ids.shape, NEVER, np.int64)
                made = np.full(ids.shape, -1, np.int64)
                rank[:, :-1], made[:, :-1] = self.pair_lookup(ids[:, :-1], ids[:, 1:])
                live = np.arange(len(part))
                while len(live):
                    at = rank[live].argmin(axis=1)
                    go = rank[live, at] < NEVER
                    live, at = live[go], at[go]
                    if not len(live):
                        break
                    new = made[live, at]
                    take = np.minimum(cols + (cols > at[:, None]), hi - 1)
                    for m, fill in ((ids, -1), (rank, NEVER), (made, -1)):
                        m[live] = np.take_along_axis(m[live], take, axis=1)
                        m[live, -1] = fill
                    ids[live, at] = new
                    after = np.where(at + 1 < hi, ids[live, np.minimum(at + 1, hi - 1)], -1)
                    rank[live, at], made[live, at] = self.pair_lookup(new, after)
                    b = at > 0
                    r, c = live[b], at[b] - 1
                    rank[r, c], made[r, c] = self.pair_lookup(ids[r, c], new[b])
                keep = ids >= 0
                words_.append(np.repeat(part, keep.sum(axis=1)))
                toks.append(ids[keep])
        if not words_:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, t = np.concatenate(words_), np.concatenate(toks)
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def encode_words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all (non-empty) words, and their number for each word."""
        start, end = off[:-1], off[1:]
        lens = end - start
        wide, short = np.flatnonzero(lens > WIDE), np.flatnonzero(lens <= WIDE)
        w, t = self.greedy(data, start[short], end[short])
        lw, lt = self.greedy_wide(data, start[wide], end[wide])
        w, t = np.concatenate([short[w], wide[lw]]), np.concatenate([t, lt])
        same = w[1:] == w[:-1]
        a, b = t[:-1][same], t[1:][same]
        pair, back = np.unique(a * self.n + b, return_inverse=True)
        bad = ~self.compatible(pair // self.n, pair % self.n)[back]
        wrong = np.unique(w[1:][same][bad])
        keep = ~np.isin(w, wrong)
        few = wrong[lens[wrong] <= WIDE]
        mw, mt = self.merge_many(data, start[few], end[few])
        ws, ts = [w[keep], few[mw]], [t[keep], mt]
        for i in wrong[lens[wrong] > WIDE].tolist():
            got = self.merge(data[start[i]:end[i]].tobytes())
            ws.append(np.full(len(got), i, np.int64))
            ts.append(np.array(got, np.int64))
        w, t = np.concatenate(ws), np.concatenate(ts)
        order = np.argsort(w, kind="stable")
        return t[order], np.bincount(w, minlength=len(lens))

    def encode_texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each."""
        cut = borders(data, off)
        chunk, back = distinct(data, cut)
        cdata, coff = utf8_bytes(chunk)
        piece_off, per_chunk, special = pieces(cdata, coff, self.special)
        ids, counts = self._piece_ids(cdata, piece_off, special)
        at = np.concatenate(([0], np.cumsum(counts)))
        first = np.concatenate(([0], np.cumsum(per_chunk)))
        chunk_at, chunk_n = at[first[:-1]], at[first[1:]] - at[first[:-1]]
        n = chunk_n[back]
        out = ids[_ranges(chunk_at[back], n)]
        ends = np.concatenate(([0], np.cumsum(n)))
        return out, np.diff(ends[np.searchsorted(cut[:-1], off)]) if len(cut) > 1 else np.zeros(len(off) - 1, np.int64)

    def _piece_ids(self, data, off, special):
        word, back = distinct(data, off)
        wdata, woff = utf8_bytes(word)
        ids, n = self.encode_words(wdata, woff)
        at = np.concatenate(([0], np.cumsum(n)))
        if not special:
            return ids[_ranges(at[:-1][back], n[back])], n[back]
        own = np.array(list(special.values()), np.int64)  # special tokens stand for whole pieces
        rows = np.array(list(special), np.int64)
        start, count = at[:-1][back], n[back].copy()
        start[rows], count[rows] = len(ids) + np.arange(len(rows)), 1
        return np.concatenate([ids, own])[_ranges(start, count)], count

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, with what isn't UTF-8 replaced."""
        raw = self.text_all[_ranges(self.text_at[ids], self.text_len[ids])].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


def borders(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets of chunks that the pre-tokenizer's pieces never cross: texts
    are cut before a space or line feed between two characters that are not
    ASCII white space (a piece always ends there)."""
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14), *range(28, 32)]] = True
    ws = blank[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        here = (data[1:-1] == 32) | (data[1:-1] == 10)
        cut[1:-2] = here & ~ws[:-2] & ~ws[2:]
    cut[off] = True
    return np.flatnonzero(cut)


def distinct(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct byte strings between offsets, and for each its number."""
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    d = arr.dictionary_encode()
    return d.dictionary, d.indices.to_numpy().astype(np.int64)


def utf8_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    buf = arr.buffers()[2]
    raw = np.frombuffer(buf, np.uint8) if buf is not None and len(buf) else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, special: dict[bytes, int]):
    """Piece offsets of all chunks, pieces for each chunk, {piece: special id}.

    Chunks like `` word,`` are cut without a regular expression: an optional
    space or line feed, Latin letters, then ASCII punctuation without an
    apostrophe."""
    n = len(off) - 1
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), {}
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    mark = np.zeros(256, bool)
    mark[[b for b in range(33, 127) if not letter[b] and not 48 <= b <= 57 and b != 39]] = True
    start, end = off[:-1], off[1:]
    is_l, is_p = letter[data], mark[data]
    two = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # accented Latin letters
    is_l[:-1] |= two
    is_l[1:] |= two
    feed = data[start] == 10  # a line feed before a letter is a piece of its own
    s = start + ((data[start] == 32) | feed)
    odd = ~is_l & ~is_p
    back_in = np.zeros(len(data), bool)
    back_in[1:] = is_l[1:] & ~is_l[:-1]
    sums = lambda m: np.concatenate(([0], np.cumsum(m)))
    n_odd, n_back, n_l = sums(odd), sums(back_in), sums(is_l)
    safe = np.minimum(s, len(data) - 1)
    plain = (s < end) & is_l[safe] & (n_odd[end] == n_odd[s]) & (n_back[end] - n_back[np.minimum(s + 1, end)] == 0)
    if special:
        plain &= ~np.isin(np.arange(n), _holding(data, off, special))
    tail = s + n_l[end] - n_l[s]  # where the punctuation begins
    per = np.where(plain, feed + 1 + (tail < end), 0)
    slow_cuts, named = {}, {}
    for i in np.flatnonzero(~plain).tolist():
        slow_cuts[i] = _cut(data[start[i]:end[i]].tobytes(), special)
        per[i] = len(slow_cuts[i])
    first = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros(first[-1] + 1, np.int64)
    out[-1] = off[-1]
    out[first[:-1][plain]] = start[plain]
    more = plain & feed
    out[first[:-1][more] + 1] = s[more]
    more = plain & (tail < end)
    out[first[:-1][more] + 1 + feed[more]] = tail[more]
    for i, cuts in slow_cuts.items():
        for k, (at, token) in enumerate(cuts):
            out[first[i] + k] = start[i] + at
            if token is not None:
                named[int(first[i]) + k] = token
    return out, per, named


def _holding(data, off, special) -> np.ndarray:
    """Chunks that hold a special token."""
    raw, at = data.tobytes(), []
    for s in special:
        p = raw.find(s)
        while p >= 0:
            at.append(p)
            p = raw.find(s, p + 1)
    return np.unique(np.searchsorted(off, np.array(at, np.int64), side="right") - 1)


def _cut(chunk: bytes, special) -> list[tuple[int, int | None]]:
    """(offset, special id or None) of the pieces of one chunk."""
    out, at = [], 0
    while at < len(chunk):
        found = min(((p, s) for s in special if (p := chunk.find(s, at)) >= 0), default=(len(chunk), b""))
        text = chunk[at:found[0]].decode()
        pos = at
        for m in PIECES.finditer(text):
            out.append((pos, None))
            pos += len(m.group().encode())
        at = found[0]
        if found[1]:
            out.append((at, special[found[1]]))
            at += len(found[1])
    return out


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (uint32 little-endian bytes), n_tokens, decoded text of every row.

    Ids are those of the vocabulary's own BPE without added special tokens
    (a special token's string in a text is that token); decoding keeps them.
    Null and empty texts have no ids and decode to the empty text; repeated
    rows and null ids stay rows; an empty table gives an empty result; other
    columns are not read.
    """
    return _run(docs, path, id_col, text_col, "doc_id long, ids binary, n_tokens long, decoded string",
                lambda ids, text: (ids.astype("<u4").tobytes(), len(ids), text.decode()))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests instead of the contents."""
    return _run(docs, path, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                lambda ids, text: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))


def _run(docs, path, id_col, text_col, schema, row):
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Bpe(path or tokenizer_path("byte_bpe_50k.json")))

    def run(batches):
        bpe = shared.value
        for b in batches:
            for part in by_bytes(b, 1):
                data, off = utf8(part.column(1))
                ids, n = bpe.encode_texts(data, off)
                ends = np.cumsum(n)
                rows = [row(own := ids[e - k:e], bpe.decode(own)) for e, k in zip(ends.tolist(), n.tolist())]
                cols = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([])] * (len(schema.split(",")) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [c.split()[0] for c in schema.split(",")])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
