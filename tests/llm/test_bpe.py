"""Speculative BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from kairos.llm import bpe as B
from kairos.llm.common import utf8

SCHEMA = "doc_id long, text string, ids string, n_tokens string, decoded string"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer
    path = B.tokenizer_path("byte_bpe_50k.json")
    return B.Bpe(path), Tokenizer.from_file(path)


def fuzz(n, seed):
    rng = random.Random(seed)
    parts = list("aeiou tnsrThe  \n\n.,'!?0129éßñ漢字🎉\xa0 \t\x1c\x85") + ["'s", "'ll", " the", " un", "<|endoftext|>", "ing", "zzzz", "\r\n", "　", "é́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", None, " ", "\n", "a" * 700, "ab" * 300 + "é" * 200]


def test_ids_and_decoding(both):
    bpe, tok = both
    texts = fuzz(4000, 11)
    ids, n = bpe.encode_texts(*utf8(pa.array(texts)))
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends.tolist(), n.tolist()):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert ids[e - k:e].tolist() == want, t
        assert bpe.decode(ids[e - k:e]).decode() == tok.decode(want, skip_special_tokens=False)


def test_broken_sequences_decode_alike(both):
    bpe, tok = both
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, 50257, 8)
        assert bpe.decode(ids).decode() == tok.decode(ids.tolist(), skip_special_tokens=False)


def test_pairs_are_compatible_exactly_if_bpe_keeps_them(both):
    bpe, _ = both
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    want = [bpe.merge(bpe.text[x] + bpe.text[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert bpe.compatible(a, b).tolist() == want and 0 < sum(want) < 3000


def test_wide_words_are_proposed_and_verified(both, monkeypatch):
    """Words of any length: the proposal is the longest match, only words with
    an incompatible pair are merged; block borders change nothing."""
    bpe, tok = both
    rng = random.Random(8)
    parts = ["ing", "the", "un", "x", "zz", "tion", "qu", "e", "s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(30, 400))) for _ in range(60)] + ["-" * 4096, "=" * 70, "a" * 65]
    data, off = utf8(pa.array(texts))
    merged, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda word: merged.append(word) or merge(word))
    for block in (7, 1 << 16):
        monkeypatch.setattr(B, "BLOCK", block)
        w, t = bpe.greedy_wide(data, off[:-1], off[1:])
        w2, t2 = bpe.greedy(data, off[:-1], off[1:])
        assert w.tolist() == w2.tolist() and t.tolist() == t2.tolist()
        merged.clear()
        ids, n = bpe.encode_words(data, off)
        ends = np.cumsum(n)
        for i, text in enumerate(texts):
            want = tok.encode(text, add_special_tokens=False).ids
            assert ids[ends[i] - n[i]:ends[i]].tolist() == want
            assert len(text) <= B.WIDE or (text.encode() in merged) == (t[w == i].tolist() != want)
        assert 0 < len(merged) < len(texts)


def test_small_table(spark, both):
    _, tok = both
    rows = list(enumerate(fuzz(200, 5))) + [(3, "twice"), (3, "twice"), (None, "no id")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in B.digests(df).collect()), key=str)
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = {r["doc_id"]: r for r in B.encode_decode(df.limit(50)).collect()}
    assert all(r["decoded"] == (rows[d][1] or "") and len(r["ids"]) == 4 * r["n_tokens"] for d, r in full.items())
    assert B.digests(df.limit(0)).count() == 0 and B.encode_decode(df.limit(0)).count() == 0
