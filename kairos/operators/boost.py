"""Multiclass histogram gradient boosting.

Features become bin numbers once. A level of all classes' trees of a round is
one pass over the rows: each task adds gradients and hessians by (class, node,
feature, bin), sums meet in one aggregation, and the best split of a node is
an aggregate over its bins. Only splits (at most classes x nodes rows) and the
losses reach the driver, where the trees are held. Rows carry their scores,
which are written again every ``STEP`` rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import layer_table, ship_package

STEP = 10
DIGITS = 9  # gains are compared after rounding: the order of sums must not choose


@dataclass
class Params:
    rounds: int = 500
    patience: int = 30
    rate: float = 0.05
    depth: int = 5
    bins: int = 64
    ridge: float = 1.0
    least_hessian: float = 1e-3
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    bagging_every: int = 5
    seed: int = 42


@dataclass
class Model:
    """``trees[r][c]`` maps node -> (feature, bin, gain) or (-1, -1, value);
    node i has the children 2 i + 1 (bin or lower) and 2 i + 2."""

    features: list
    classes: list
    edges: list
    rate: float
    trees: list = field(default_factory=list)
    curve: list = field(default_factory=list)  # (round, train loss, valid loss)

    def predict(self, df: DataFrame, out: str = "probabilities") -> DataFrame:
        """``df`` with an array of class probabilities; a null or NaN feature
        counts as lowest."""
        model = self

        @F.pandas_udf("array<double>")
        def proba(rows: pd.DataFrame) -> pd.Series:
            b = binned(rows.to_numpy(float, na_value=np.nan), model.edges)
            s = np.zeros((len(b), len(model.classes)))
            for trees in model.trees:
                s += model.rate * outputs(trees, b)
            return pd.Series(softmax(s).tolist())

        return df.withColumn(out, proba(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)])))

    def splits(self) -> list[tuple]:
        """(round, class, node, feature, threshold, gain, value) of all nodes;
        values up to the threshold go left, without one only missing values."""
        return [(r, self.classes[c], n, self.features[f] if f >= 0 else None, float(self.edges[f][b - 1]) if f >= 0 and b else None,
                 v if f >= 0 else None, v if f < 0 else None)
                for r, trees in enumerate(self.trees) for c, tree in enumerate(trees) for n, (f, b, v) in sorted(tree.items())]


def binned(x: np.ndarray, edges: list) -> np.ndarray:
    """Bin of each value: 0 for missing ones, else 1 + the edges below it."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        ok = ~np.isnan(x[:, j])
        out[ok, j] = 1 + np.searchsorted(e, x[ok, j], side="left")
    return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def reach(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The deepest node of each row in a tree."""
    node = np.zeros(len(bins), np.int64)
    for n in sorted(tree):
        f, b, _ = tree[n]
        if f >= 0:
            at = node == n
            node[at] = 2 * n + 1 + (bins[at, f] > b)
    return node


def outputs(trees: list, bins: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bins), len(trees)))
    for c, tree in enumerate(trees):
        node = reach(tree, bins)
        for n, (f, _, v) in tree.items():
            if f < 0:
                out[node == n, c] = v
    return out


def in_bag(ids: np.ndarray, p: Params, r: int) -> np.ndarray:
    """Rows that round ``r`` learns from, by a hash of the row's id."""
    if p.bagging_fraction >= 1:
        return np.ones(len(ids), bool)
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) ^ np.uint64(p.seed * 1_000_003 + r // p.bagging_every)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / (1 << 53) < p.bagging_fraction


def chosen_features(n: int, p: Params, r: int) -> list[int]:
    k = max(1, round(p.feature_fraction * n))
    return sorted(np.random.default_rng([p.seed, r]).choice(n, k, replace=False).tolist())


def _prepared(df: DataFrame, features, label, classes, valid, key, p: Params) -> tuple[DataFrame, list]:
    """(id, y, w, valid, bins, scores), written once, and the bins' edges from
    approximate quantiles of the learning rows (rank error 0.001)."""
    num = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    x = df.select(F.xxhash64(*key).alias("id"), y.alias("y"), F.col(valid).alias("valid"), *num).filter("y >= 0")
    learn = x.filter(~F.col("valid"))
    probs = [i / p.bins for i in range(1, p.bins)]
    edges = [sorted({float(v) for v in q if v == v}) for q in learn.approxQuantile([f"f{i}" for i in range(len(features))], probs, 0.001)]
    # Classes weigh alike: n / (classes x rows of the class).
    counts = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = [total / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(len(classes))]

    def run(it):
        for pdf in it:
            b = binned(pdf[[f"f{i}" for i in range(len(features))]].to_numpy(float, na_value=np.nan), edges)
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "w": np.asarray(weight)[pdf["y"]], "valid": pdf["valid"],
                                "bins": [r.tobytes() for r in b], "scores": [[0.0] * len(classes)] * len(b)})

    return layer_table(x.mapInPandas(run, SCHEMA), "boost-rows"), edges


SCHEMA = "id long, y int, w double, valid boolean, bins binary, scores array<double>"


def _arrays(pdf, n_features: int, fresh: list, rate: float):
    """Bins, and scores after the rounds since they were written."""
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), n_features)
    s = np.stack(pdf["scores"].to_list())
    for trees in fresh:
        s = s + rate * outputs(trees, bins)
    return bins, s


def histograms(rows: DataFrame, model: Model, fresh: list, partial: list, level: int, r: int, p: Params) -> DataFrame:
    """(c, node, f, bin, g, h): sums over the learning rows of the open nodes of
    a level; with level 0 also the losses as c = -1, f = 0 (learning rows) and 1
    (validation rows): g the weighted loss, h the weight."""
    n_f, k, rate = len(model.features), len(model.classes), model.rate
    use = chosen_features(n_f, p, r)
    first = 2 ** level - 1
    width = p.bins + 1

    def run(it):
        acc = np.zeros((k, 2 ** level, n_f, width, 2))
        loss = np.zeros((2, 2))
        for pdf in it:
            bins, s = _arrays(pdf, n_f, fresh, rate)
            prob = softmax(s)
            y, w, valid = pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["valid"].to_numpy(bool)
            if not level:
                each = -np.log(np.maximum(prob[np.arange(len(y)), y], 1e-300)) * w
                for i, m in enumerate((~valid, valid)):
                    loss[i] += each[m].sum(), w[m].sum()
            on = np.flatnonzero(~valid & in_bag(pdf["id"].to_numpy(), p, r))
            bins, prob, y, w = bins[on], prob[on], y[on], w[on]
            for c in range(k):
                node = reach(partial[c], bins) - first
                live = node >= 0
                g, h = w * (prob[:, c] - (y == c)), w * prob[:, c] * (1 - prob[:, c])
                for f in use:
                    at = (node[live] * width + bins[live, f]).astype(np.int64)
                    for i, v in enumerate((g, h)):
                        acc[c, :, f, :, i] += np.bincount(at, v[live], 2 ** level * width).reshape(-1, width)
        c, n, f, b = np.nonzero(acc.any(axis=-1))
        yield pd.DataFrame({"c": c, "node": n + first, "f": f, "bin": b, "g": acc[c, n, f, b, 0], "h": acc[c, n, f, b, 1]})
        if not level:
            yield pd.DataFrame({"c": [-1, -1], "node": [0, 0], "f": [0, 1], "bin": [0, 0], "g": loss[:, 0], "h": loss[:, 1]})

    out = rows.mapInPandas(run, "c int, node int, f int, bin int, g double, h double")
    return out.groupBy("c", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(hist: DataFrame, p: Params) -> DataFrame:
    """The best split of each node: largest rounded gain, then lowest feature,
    then lowest bin; losses pass through. A window holds one feature's bins."""
    w = Window.partitionBy("c", "node", "f")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumns({"gl": F.sum("g").over(run), "hl": F.sum("h").over(run), "gt": F.sum("g").over(w), "ht": F.sum("h").over(w)})
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    half = lambda g, h: g * g / (h + F.lit(p.ridge))
    gain = half(F.col("gl"), F.col("hl")) + half(gr, hr) - half(F.col("gt"), F.col("ht"))
    ok = (F.col("hl") >= p.least_hessian) & (hr >= p.least_hessian)
    x = x.withColumn("gain", F.when(ok, F.round(gain, DIGITS)).otherwise(F.lit(-1.0)))
    best = F.max_by(F.struct("f", "bin", "gain", "gl", "hl", "gt", "ht"), F.struct("gain", -F.col("f"), -F.col("bin")))
    losses = x.filter("c < 0").select("c", "node", F.struct("f", "bin", "gain", "gl", "hl", "gt", "ht").alias("s"))
    return x.filter("c >= 0").groupBy("c", "node").agg(best.alias("s")).unionByName(losses).select("c", "node", "s.*")


def train(df: DataFrame, features, label: str, classes, valid: str, key, p: Params | None = None) -> Model:
    """Boosted trees for each class, softmax loss, classes weighted alike.

    Rows with ``valid`` are held out: their loss stops the training after
    ``patience`` rounds without gain, and the trees up to the best round are
    kept. Rows whose label is none of ``classes`` are left out; without
    learning rows the model has no trees and scores all classes alike.
    """
    p = p or Params()
    ship_package(df.sparkSession)
    rows, edges = _prepared(df, features, label, classes, valid, key, p)
    model = Model(list(features), list(classes), edges, p.rate)
    fresh: list = []
    best, kept = np.inf, 0
    leaf = lambda g, h: float(-g / (h + p.ridge))
    for r in range(p.rounds + 1):
        trees: list = [{} for _ in classes]
        for level in range(p.depth):
            got = best_splits(histograms(rows, model, fresh, trees, level, r, p), p).collect()  # classes x nodes rows
            if not level:
                loss = {x["f"]: x["gl"] / x["hl"] if x["hl"] else None for x in got if x["c"] < 0}
                model.curve.append((r, loss.get(0), loss.get(1)))
                held = loss.get(1) if loss.get(1) is not None else loss.get(0)
                if held is None:
                    return model
                if held < best - 1e-12:
                    best, kept = held, r
                if r - kept >= p.patience or r == p.rounds:
                    model.trees = model.trees[:kept]
                    return model
            grew = False
            for x in got:
                if x["c"] < 0:
                    continue
                tree, n = trees[x["c"]], x["node"]
                if x["gain"] > 0:
                    tree[n] = (x["f"], x["bin"], x["gain"])
                    tree[2 * n + 1] = (-1, -1, leaf(x["gl"], x["hl"]))
                    tree[2 * n + 2] = (-1, -1, leaf(x["gt"] - x["gl"], x["ht"] - x["hl"]))
                    grew = True
                elif n not in tree:
                    tree[n] = (-1, -1, leaf(x["gt"], x["ht"]))
            if not grew:
                break
        model.trees.append(trees)
        fresh.append(trees)
        if len(fresh) == STEP:
            held_trees, n_f = list(fresh), len(features)

            def rescored(it):
                for pdf in it:
                    _, s = _arrays(pdf, n_f, held_trees, p.rate)
                    yield pdf.assign(scores=s.tolist())

            rows, fresh = layer_table(rows.mapInPandas(rescored, SCHEMA), "boost-rows"), []
    return model
