"""Keyword automaton and exact quantiles against plain searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kairos.functions import keywords as K
from kairos.functions import text as TX
from kairos.operators import aggregates as A


@pytest.mark.parametrize("whole", [False, True])
def test_ten_thousand_keywords(spark, monkeypatch, whole):
    """Keywords of the given tables' words; parts of the dictionary split it."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    seen = sorted({w.lower() for r in docs.collect() for w in (r.text or "").split()})
    names = [r.c_name for r in spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_name").collect()]
    words = (seen + names + [f"{n} {i}" for i in range(99) for n in names])[:10_000]
    assert len(words) == 10_000
    entries = {f"e{i}": words[i::2500] for i in range(2500)}
    monkeypatch.setattr(K, "PART", 40_000)
    got = {r.doc_id: r.m for r in docs.select("doc_id", K.match_dictionary(spark, F.col("text"), entries, whole).alias("m")).collect()}
    inside = lambda c: c.isalnum() or c == "_"

    def occurs(w, t):
        at = t.find(w)
        while at >= 0:
            if not whole or not ((at and inside(t[at - 1])) or (at + len(w) < len(t) and inside(t[at + len(w)]))):
                return True
            at = t.find(w, at + 1)
        return False

    for r in docs.orderBy("doc_id").collect()[::20]:
        t = r.text.lower()
        assert got[r.doc_id] == [e for e, ws in entries.items() if any(occurs(w.lower(), t) for w in ws)]


def test_equals_expression(spark):
    d = {"A": ["and", "the cat"], "B": ["É"], "C": ["x_y", "c++"], "D": ["zz"]}
    df = spark.createDataFrame([("The Cat and c++",), ("sand x_y",), (None,), ("",), ("été É",), ("c++x",)], "t string")
    for whole in (False, True):
        rows = df.select(K.match_dictionary(spark, F.col("t"), d, whole).alias("a"), TX.match_keywords("t", d, whole).alias("b"), "t").collect()
        assert all(r.a == r.b for r in rows if r.t is not None) and rows[2].a is None


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.lognormal(0, 3, 501)] + [("b", float(v)) for v in rng.integers(0, 4, 300)] + [("c", 5.0)] * 40
    rows += [("d", None), ("d", float("nan")), (None, 2.0), (None, 3.0), ("e", 1e308), ("e", -1e308), ("e", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ps = [0.0, 0.15, 0.5, 0.99, 1.0]
    got = {(r.g, r.p): r.value for r in A.exact_quantiles(df, "g", "v", ps, limit=limit, bins=16).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == {(g, p) for g in groups for p in ps}
    for (g, p), v in got.items():
        s = sorted(groups[g])
        pos = p * (len(s) - 1)
        lo, hi = int(np.floor(pos)), int(np.ceil(pos))
        want = s[lo] if lo == hi else (1 - (pos - lo)) * s[lo] + (pos - lo) * s[hi]
        assert v == pytest.approx(want, rel=1e-12), (g, p)
    assert A.exact_quantiles(df.limit(0), "g", "v", ps).count() == 0
