"""Periodic runs against a plain search of all periods."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kairos.llm import runs as R


def brute_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda t: (t[0], t[2]))
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % t for t in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_cover():
    d = sorted((a - b) % R.CYCLE for a in R.COVER for b in R.COVER if a != b)
    assert d == list(range(1, R.CYCLE))


piece = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12))
text = st.lists(piece, max_size=6).map(lambda ps: [x for w, k in ps for x in w * k])


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=5))
def test_runs(texts):
    got = R.find([np.array(t, np.int64) for t in texts], 3)
    assert [sorted(got.get(i, [])) for i in range(len(texts))] == [sorted(brute_runs(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=200), st.data())
def test_extension(w, data):
    seq = np.array(w + [7])
    ext = R.Extension(seq)
    a = data.draw(st.integers(0, len(w) - 2))
    b = data.draw(st.integers(a + 1, len(w) - 1))
    n = 0
    while b + n < len(w) and w[a + n] == w[b + n]:
        n += 1
    assert ext(np.array([a]), np.array([b])).tolist() == [n] == ext(np.array([b]), np.array([a])).tolist()


def test_collapse():
    assert R.collapse(["", "x " + "a b " * 5 + "c", " one\ttwo ", "z " * 6, "z " * 5]) == ["", "x a b c", "one two", "z", "z z z z z"]


def test_long_text():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 50, 60_000)
    w[1000:50_000] = w[1000:8000][np.arange(49_000) % 7000]
    w[52_000:59_000] = 3
    (big, one) = [r for r in R.find([w, w[:10]], 50)[0] if r[1] > 1000]
    assert big[0] <= 1000 and big[2] == 7000 and one[2] == 1 and one[1] >= 7000


def rows():
    t = ["", None, " \t\n", "a", "a " * 6, "a b " * 40, "ä ö x " * 9, "w " * 3000, "the cat sat " * 50 + "on a mat " * 30, "A a A a A a A a A a"]
    return [(i, t[i % len(t)]) for i in range(200)] + [(7, "x y z " * 8)] * 2 + [(None, "x y z " * 8), (None, None)]


def test_rows(spark):
    df = spark.createDataFrame([(d, t, "q", "r") for d, t in rows()], "doc_id long, text string, period string, n_runs string")
    assert sorted(map(tuple, R.report(df.repartition(3)).collect()), key=str) == sorted((brute(d, t) for d, t in rows()), key=str)
    assert R.report(df.limit(0)).count() == 0


def test_query(spark):
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    got = entry.queries()["op12_runs"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(d, t) for d, t in docs), key=str)
    assert sum(r.n_runs > 0 for r in got) > 5
