"""Content-defined chunking: boundaries, fingerprints and the edited report."""

import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kairos.llm import cdc as C
from kairos.llm.common import utf8

SCHEMA = "doc_id long, text string, bucket string, guest string, fingerprint string"


def brute_borders(raw):
    strict, loose = [], []
    for i in range(len(raw)):
        h = 0
        for b in (bytes(32) + raw)[i + 1:i + 33]:
            h = ((h << 1) + int(C.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - C.LOOSE) == 0:
            loose.append(i + 1)
        if h >> (32 - C.STRICT) == 0:
            strict.append(i + 1)
    return strict, loose


def brute_fp(text):
    raw = text.encode()
    import xxhash
    strict, loose = brute_borders(raw)
    at, marks = 0, set()
    while at < len(raw):
        end = len(raw)
        if end - at > C.LEAST:
            cut = [x for x in strict if at + C.LEAST <= x < at + C.NORMAL][:1] or [x for x in loose if at + C.NORMAL <= x <= at + C.MOST][:1]
            end = min(end, cut[0] if cut else at + C.MOST)
        marks.add((xxhash.xxh64_intdigest(raw[at:end]) >> 8) << 8 | end - at)
        at = end
    return "".join("%016x" % x for x in sorted(marks))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=400), st.text("ab", max_size=700)), max_size=6))
def test_fingerprints(texts):
    texts = [t.encode(errors="ignore").decode() for t in texts]
    assert C.fingerprints(*utf8(pa.array(texts, pa.string()))) == [brute_fp(t) for t in texts]


def test_shift_resistance():
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(3000)]
    t = " ".join(rng.choice(words, 3000))
    a, b, c = C.fingerprints(*utf8(pa.array([t, "something new. " + t[:5000] + " middle " + t[5000:], " ".join(rng.choice(words, 3000))])))
    assert C.containment(a, b) > 0.95 and C.likeness(a, b) > 0.95 and C.likeness(a, c) < 0.05
    sizes = sorted(C.marks(a).values())  # the last chunk may be shorter
    assert C.LEAST <= sizes[1] and sizes[-1] <= C.MOST and 40 < np.mean(sizes) < 110


def check(rows, got):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    rows = sorted(rows, key=key, reverse=True)
    want = []
    for i, (d, t) in enumerate(rows):
        t, x = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        e = t[:len(t) - k] + x[:k]
        fp, fe, fx = C.fingerprints(*utf8(pa.array([t, e, x])))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp, fe, C.likeness(fp, fe), C.likeness(fp, fx)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_table(spark):
    texts = ["", None, "é" * 1000, "short", "漢字 text " * 40, "x" * 100_000, "same text here", "same text here"] + ["doc %d " % i * 50 for i in range(30)]
    rows = [(i * 31 % 97, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, "no id"), (None, "none")]
    df = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA).repartition(3)
    for buckets in (1, 7, 40):
        check(rows, C.report(df, buckets=buckets).collect())
    check([(9, "one row only")], C.report(spark.createDataFrame([(9, "one row only")], "doc_id long, text string")).collect())


def test_empty_table(spark):
    df = C.report(spark.createDataFrame([], SCHEMA))
    assert df.columns == [c.split()[0] for c in C.SCHEMA.split(", ")] and df.count() == 0


def test_query_matches_brute_force(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_SMALL
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, catalog.q_fingerprints(spark, SF_SMALL).collect())
