"""Gradient boosting against plain loops over rows, and its reports."""

import math

import numpy as np
import pytest

from conftest import SF_SMALL
from kairos.operators import boost as B
from kairos.operators import ml as N

CLASSES = ["a", "b", "c"]


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = [CLASSES[int(v)] for v in np.clip((x[:, 0] > 0.2).astype(int) + (x[:, 1] * x[:, 0] > 0.1) + (rng.random(n) < 0.1), 0, 2)]
    rows = [(i, None if i % 17 == 0 else float(x[i, 0]), *map(float, x[i, 1:]), y[i], i % 4 == 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, p double, q double, r double, s double, label string, held boolean").repartition(5)


def plain(rows, ids, edges, p):
    """The same trees by loops: rows are (id, features, label, held)."""
    feats = [[float("nan") if v is None else v for v in r[1:5]] for r in rows]
    bins = [[0 if math.isnan(v) else 1 + sum(e < v for e in edges[j]) for j, v in enumerate(f)] for f in feats]
    y, held = [CLASSES.index(r[5]) for r in rows], [r[6] for r in rows]
    count = [sum(1 for c, h in zip(y, held) if c == k and not h) for k in range(3)]
    w = [sum(count) / (3 * count[c]) for c in y]
    score, trees, curve = [[0.0] * 3 for _ in rows], [], []
    prob = lambda s: [math.exp(v) / sum(map(math.exp, s)) for v in s]
    for r in range(p.rounds + 1):
        loss = []
        for side in (False, True):
            at = [i for i in range(len(rows)) if held[i] == side]
            loss.append(sum(-math.log(prob(score[i])[y[i]]) * w[i] for i in at) / sum(w[i] for i in at))
        curve.append((r, *loss))
        if r == p.rounds:
            return trees, curve
        bag = B.in_bag(np.array(ids), p, r)
        use = B.chosen_features(4, p, r)
        own = []
        for c in range(3):
            g = [w[i] * (prob(score[i])[c] - (y[i] == c)) for i in range(len(rows))]
            h = [w[i] * prob(score[i])[c] * (1 - prob(score[i])[c]) for i in range(len(rows))]
            tree, todo = {}, [(0, [i for i in range(len(rows)) if not held[i] and bag[i]], 0)]
            while todo:
                n, at, level = todo.pop()
                gt, ht = sum(g[i] for i in at), sum(h[i] for i in at)
                best = None
                if level < p.depth:
                    for f in use:
                        for b in sorted({bins[i][f] for i in at}):
                            left = [i for i in at if bins[i][f] <= b]
                            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                            if hl < p.least_hessian or ht - hl < p.least_hessian:
                                continue
                            gain = round(gl * gl / (hl + p.ridge) + (gt - gl) ** 2 / (ht - hl + p.ridge) - gt * gt / (ht + p.ridge), 9)
                            if gain > 0 and (best is None or gain > best[0] + 5e-10):
                                best = (gain, f, b, left)
                if best is None:
                    tree[n] = (-1, -1, -gt / (ht + p.ridge))
                else:
                    gain, f, b, left = best
                    tree[n] = (f, b, gain)
                    todo += [(2 * n + 1, left, level + 1), (2 * n + 2, [i for i in at if i not in set(left)], level + 1)]
            own.append(tree)
        trees.append(own)
        for i in range(len(rows)):
            for c in range(3):
                n = 0
                while own[c][n][0] >= 0:
                    f, b, _ = own[c][n]
                    n = 2 * n + 1 + (bins[i][f] > b)
                score[i][c] += p.rate * own[c][n][2]


def test_trees_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(B, "STEP", 2)  # scores are written again on the way
    rows, df = table(spark)
    p = B.Params(rounds=3, depth=2, bins=8, rate=0.3, feature_fraction=0.75, bagging_fraction=0.8, bagging_every=2)
    m = B.train(df, ["p", "q", "r", "s"], "label", CLASSES, "held", ["id"], p)
    from pyspark.sql import functions as F
    ids = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    trees, curve = plain(rows, [ids[r[0]] for r in rows], m.edges, p)
    assert np.allclose(m.curve, curve, rtol=1e-9)
    assert len(m.trees) == 3 and all(len(e) <= 7 for e in m.edges)
    for got, want in zip(m.trees, trees):
        for a, b in zip(got, want):
            assert set(a) == set(b)
            for n in a:
                assert a[n][:2] == b[n][:2] and a[n][2] == pytest.approx(b[n][2], rel=1e-7, abs=1e-8)


def test_stops_and_predicts(spark):
    rows, df = table(spark, 600)
    p = B.Params(rounds=9, patience=2, depth=2, bins=16, rate=1.5, bagging_fraction=1.0, feature_fraction=1.0)
    m = B.train(df, ["p", "q", "r", "s"], "label", CLASSES, "held", ["id"], p)
    losses = [v for _, _, v in m.curve]
    best = int(np.argmin(losses))
    assert len(m.trees) == best and (best == 9 or len(m.curve) == best + 3)
    out = m.predict(df).select("label", "probabilities").collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-12 for r in out)
    assert np.mean([CLASSES[int(np.argmax(r.probabilities))] == r.label for r in out]) > 0.7
    none = B.train(df.limit(0), ["p"], "label", CLASSES, "held", ["id"], p)
    assert none.trees == [] and none.predict(df).first().probabilities == pytest.approx([1 / 3] * 3)


def test_reports(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    cm = q["action_confusion"](spark, SF_SMALL).collect()
    metrics = {r.cls: r for r in q["action_model"](spark, SF_SMALL).collect()}
    assert len(cm) == 16 and sum(r.n for r in cm) == sum(r.support or 0 for r in metrics.values())
    assert metrics["__summary"].accuracy == pytest.approx(sum(r.n for r in cm if r.actual == r.predicted) / sum(r.n for r in cm))
    imp = q["action_importance"](spark, SF_SMALL).collect()
    from kairos.plans.catalog_ml import FEATURES
    assert {r.feature for r in imp} == set(FEATURES) and any(r.splits for r in imp)
    scores = q["action_scores"](spark, SF_SMALL).collect()
    assert all(abs(r.prob_buy + r.prob_call + r.prob_put + r.prob_short - 1) < 1e-9 and r.confidence == max(r[2:6]) for r in scores)
    cov = q["action_coverage"](spark, SF_SMALL).collect()
    assert sum(r.predicted_rows for r in cov) == len(scores) and 0 < cov[0].coverage <= 1
    curve = q["action_curve"](spark, SF_SMALL).collect()
    assert curve[0].train_loss == pytest.approx(math.log(4)) and min(r.train_loss for r in curve) < curve[0].train_loss


def test_numeric_features(spark):
    df = spark.sql("SELECT 1.5D AS d, 1 AS i, CAST(1 AS DECIMAL(5,2)) AS m, 'x' AS s, TRUE AS b, DATE'2020-01-01' AS t, 2L AS fwd, CAST(1 AS FLOAT) AS A")
    assert N.numeric_features(df, ["FWD"]) == ["A", "d", "i", "m"]
