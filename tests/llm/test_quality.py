"""Quality scores: statistics, normal equations, calibration, held-out accuracy."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kairos.llm import quality as Q
from kairos.llm.common import utf8


def test_statistics_by_hand():
    x = Q.statistics(*utf8(pa.array(["Ab ab. ab\nab  ab. ab", "", None, "é1!"])))
    s = {n: x[:, i] for i, n in enumerate(Q.STATS)}
    assert np.isfinite(x).all() and not x[1].any() and not x[2].any()
    assert np.isclose(s["upper"][0], 1 / 20) and np.isclose(s["distinct_words"][0], 3 / 6) and np.isclose(s["capital_words"][0], 1 / 6)
    assert np.isclose(s["beyond"][3], 2 / 4) and np.isclose(s["log_words"][0], np.log1p(6)) and np.isclose(s["distinct_lines"][0], 1)
    assert np.isclose(s["distinct_pairs"][0], 4 / 5)


@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 1)), min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_isotonic(rows):
    w, m = (np.array(x, float) for x in zip(*rows))
    f = Q.isotonic(w, m)
    assert (np.diff(f) >= -1e-12).all() and np.isclose((f * w).sum(), (m * w).sum())
    want = [max(np.average(m[a:i + 1], weights=w[a:i + 1]) if False else min(np.average(m[a:b + 1], weights=w[a:b + 1]) for b in range(i, len(m))) for a in range(i + 1)) for i in range(len(m))]
    assert np.allclose(f, want)


def test_partition_sums(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, len(Q.STATS)))
    y = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(r.astype("<f8").tobytes(), float(v)) for r, v in zip(x, y)], "stats binary, label double").repartition(7)
    got = Q._sums(df, lambda a, b: np.hstack([a.T @ a, (a.T @ b)[:, None]]), len(Q.STATS) + 1)
    assert np.allclose(got, np.hstack([x.T @ x, (x.T @ y)[:, None]]))


def test_odd_rows(spark):
    texts = ["", None, "x" * 50_000, "A normal line of text. And another.", "BUY!! NOW!! CHEAP!!", "A normal line of text. And another."]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "no id", "c"), (4, "twice", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.scores(docs, none).collect()
    assert len(got) == 8 and all(0.49 < r["score"] < 0.51 and r["predicted"] == 1 for r in got)
    some = spark.createDataFrame([(i, i % 2, "x") for i in range(6)] + [(None, 1, "x"), (3, None, "x"), (77, 1, "x")], "doc_id long, quality int, stats string")
    got = Q.scores(docs, some).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert Q.scores(docs.limit(0), some).count() == 0


def test_held_out_accuracy(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_MID
    got = {r["doc_id"]: r for r in catalog.q_quality(spark, SF_MID).collect()}
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").collect()
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.93
