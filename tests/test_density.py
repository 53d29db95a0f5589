"""Density clusters against DBSCAN over all pairs."""

import numpy as np
import pytest

from conftest import SF_SMALL
from kairos.operators import density as D


def brute(ids, v, eps, least):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    core = (d <= eps).sum(axis=1) >= least
    name = np.arange(len(ids))
    for i in range(len(ids)):  # flood fill over core points
        if not core[i] or name[i] != i:
            continue
        todo, seen = [i], {i}
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(core & (d[x] <= eps)).tolist():
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        small = min(seen, key=lambda x: ids[x])
        for x in seen:
            name[x] = small
    out = {}
    for i in range(len(ids)):
        near = [(d[i, j], ids[j], j) for j in np.flatnonzero(core & (d[i] <= eps)).tolist()]
        out[ids[i]] = (int(ids[name[i]]), True) if core[i] else (int(ids[name[min(near)[2]]]), False) if near else (-1, False)
    return out


def run(spark, ids, v, eps, least):
    df = spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v)], "id long, v array<double>").repartition(4)
    return {r.id: (r.cluster, r.core) for r in D.clusters(df, eps, least, v.shape[1]).collect()}


@pytest.mark.parametrize("block", [2048, 20])
def test_equals_dbscan(spark, monkeypatch, block):
    """Blobs, a chain, noise and copies; also with cells cut into blocks."""
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 0.3, (120, 2)), rng.normal(4, 0.5, (80, 2)), np.stack([np.linspace(-6, 6, 60), np.full(60, -3.0)], 1),
                        rng.uniform(-8, 8, (60, 2)), np.full((30, 2), 7.5), np.full((3, 2), -7.5)])
    ids = rng.permutation(len(v)) * 3 + 1
    monkeypatch.setattr(D, "BLOCK", block)
    got, want = run(spark, ids, v, 0.35, 5), brute(ids, v, 0.35, 5)
    assert got == want
    assert len({c for c, _ in got.values()}) > 3 and any(c == -1 for c, _ in got.values()) and any(c >= 0 and not k for c, k in got.values())


def test_odd_points(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (None, [0.0, 0.1])], "id long, v array<double>")
    got = sorted(map(str, D.clusters(df, 0.5, 2, 2).select("id", "cluster").collect()))
    assert len(got) == 6 and sum("cluster=-1" in g for g in got) == 4
    assert D.clusters(df.limit(0), 0.5, 3, 2).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    got = D.components(links).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


def test_query(spark):
    import __spark_entry__ as entry
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    pts = D.project(rows, "embedding", 3, 42, 64).select("vec_id", "v").collect()
    m = np.random.default_rng(42).normal(size=(3, 64)) / np.sqrt(3)
    emb = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    assert all(np.allclose(r.v, m @ emb[r.vec_id]) for r in pts)
    got = {r.vec_id: (r.topic_id, r.core) for r in entry.queries()["embedding_topics"](spark, SF_SMALL).collect()}
    want = brute([r.vec_id for r in pts], np.array([r.v for r in pts]), 0.25, 5)
    assert got == want and len({c for c, _ in got.values()}) > 2
