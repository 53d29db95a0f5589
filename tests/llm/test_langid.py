"""Language ID: kernel values by hand, held-out accuracy, odd rows."""

import functools
import zlib

import numpy as np
import pyarrow as pa

from kairos.llm import langid as L
from kairos.llm.common import utf8

SCHEMA = "doc_id long, text string, lang string, lang_pred string, p string"


def sets(text):
    """The distinct n-grams of a text, A-Z lower-cased, for each n."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [{low[k:k + n] for k in range(len(low) - n + 1)} for n in L.SIZES]


def blended(a, b):
    return sum(len(s & t) / np.sqrt(max(1, len(s)) * max(1, len(t))) for s, t in zip(a, b)) / len(L.SIZES)


def test_kernel_is_the_blended_presence_kernel(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["The cat", "the CAT sat", "", "z", "zzz", "é", None, "漢字 kanji", "".join(map(chr, rng.integers(32, 0x24F, 5000)))]
    arr = pa.array(texts)
    want = np.array([[blended(sets(a), sets(b)) for b in texts] for a in texts])
    for block in (5, 1 << 20):  # block borders change nothing
        monkeypatch.setattr(L, "BLOCK", block)
        marks = [L.tagged(L.spectra(*utf8(arr.slice(i, 1)))) for i in range(len(texts))]
        assert [len(m) for m in marks] == [sum(map(len, sets(t))) for t in texts]
        got = np.vstack([L.products(data, off, *L.landmark_rows(marks)) for _, data, off in L.slices(arr)])
        assert np.abs(got - want).max() < 1e-6


def brute(rows):
    """{doc_id: (lang_pred, score)} by the rules written out over sets; needs
    fewer learning rows than the sample takes."""
    import xxhash
    learn, signed = [], lambda u: u - (1 << 64) if u >= 1 << 63 else u
    for d, text, lang in rows:
        if d is not None and text is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            h = signed(xxhash.xxh64(b"langid", seed=xxhash.xxh64(str(d).encode(), seed=42).intdigest()).intdigest())
            learn.append((lang, h % (1 << 20), h, text, sets(text)))
    learn.sort(key=lambda r: r[:3])
    langs = sorted({r[0] for r in learn})
    each = max(1, L.LANDMARKS // len(langs))
    big = lambda r: sum(map(len, r[4])) > L.MARK_GRAMS
    marks = [r[4] for lang in langs for r in sorted((r for r in learn if r[0] == lang), key=big)[:each]]
    to_marks = functools.lru_cache(None)(lambda text: [blended(g, m) for g in [sets(text)] for m in marks])
    k = np.array([to_marks(r[3]) for r in learn])
    mm = np.array([[blended(a, b) for b in marks] for a in marks])
    vals, vecs = np.linalg.eigh(mm)
    ok = vals > 1e-6 * vals.max()
    half = vecs[:, ok] / np.sqrt(vals[ok])
    z = np.hstack([k @ half, np.ones((len(k), 1))])
    b = []
    for lang in langs:
        t = np.array([1.0 if r[0] == lang else -1.0 for r in learn])
        w = np.diag([1 / sum(q[0] == r[0] for q in learn) for r in learn])
        reg = L.RIDGE * np.eye(z.shape[1])
        reg[-1, -1] = 0
        b.append(np.linalg.solve(z.T @ w @ z + reg + 1e-9 * np.eye(z.shape[1]), z.T @ w @ t))
    out = {}
    for d, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[d] = ("und", 0.0)
            continue
        f = np.append(np.array(to_marks(text)) @ half, 1.0)
        s = [f @ v for v in b]
        out[d] = (langs[int(np.argmax(s))], min(1.0, max(0.0, (max(s) + 1) / 2)))
    return out


def test_whole_query_matches_brute_force(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_SMALL
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(rows)
    got = {r["doc_id"]: r for r in catalog.q_langid(spark, SF_SMALL).collect()}
    assert len(got) == len(rows) == len(want)
    for d, (lang, score) in want.items():
        assert got[d]["lang_pred"] == lang and abs(got[d]["score"] - score) < 1e-4


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog number %d" % i, "en") for i in range(40)] + [(100 + i, "der hund und die katze nummer %d" % i, "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 !!", "de"), (503, "漢字", None), (None, "the dog", "en"), (0, "the cat", None), (504, "the cat " * 20_000, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = L.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 0}
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert by[504]["lang_pred"] == "en" and by[110]["lang_pred"] == "de" and by[None]["held_out"] is False
    assert by[503]["lang_pred"] in ("en", "de")
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in by.items() if d is not None)
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in L.identify(df).collect()] == [("und", 0.0)]
    assert L.identify(df.limit(0)).count() == 0


def test_held_out_labels_are_not_read(spark):
    rows = [(i, ("the cat and the dog", "der hund und die katze")[i % 2], ("en", "de")[i % 2]) for i in range(200)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    a, b = (sorted(map(tuple, L.identify(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect())) for r in (rows, wrong))
    assert a == b


def test_held_out_accuracy(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_MID
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = catalog.q_langid(spark, SF_MID).collect()
    size = {r["doc_id"]: len(r["text"] or "") for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    held = sorted((size[r["doc_id"]], r["lang_pred"] == lang[r["doc_id"]]) for r in got if r["held_out"])
    assert len(got) == len(lang) and np.mean([ok for _, ok in held]) > 0.97
    assert np.mean([ok for _, ok in held[-len(held) // 10:]]) > 0.97  # the longest tenth
