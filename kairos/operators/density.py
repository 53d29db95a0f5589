"""Density clusters over a cell grid.

Points are reduced by a seeded random projection, then clustered as DBSCAN
does: a point with ``least`` points within ``eps`` (itself included) is a core
point, core points within ``eps`` of each other are one cluster, other points
within ``eps`` of a core point join the nearest one's cluster, the rest is -1.

Cells are ``eps`` wide, so only points of touching cells are compared. Each
pair of cells is compared in one of them, in blocks of bounded size; a block
returns counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import layer_table, ship_package

BLOCK = 2048  # points of one side of a comparison
FEW = 100_000  # large cells are broadcast up to so many counted rows


def project(df: DataFrame, vec: str, dims: int, seed: int, width: int, out: str = "v") -> DataFrame:
    """``df`` with ``out``: ``vec`` (``width`` numbers) times a seeded Gaussian
    matrix over the root of ``dims``."""
    m = np.random.default_rng(seed).normal(size=(dims, width)) / np.sqrt(dims)
    x = F.col(vec).cast("array<double>")

    def dot(row):
        return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in row]), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)

    return df.withColumn(out, F.array(*[dot(r) for r in m]))


def cells(points: DataFrame, eps: float, dims: int) -> DataFrame:
    """(cell, i, j, side, guest, ...): each point in its own cell and, as a
    guest, in the touching cells before it. A cell with more than BLOCK rows
    is dealt into blocks, and each pair (i, j) of them is a group of its own."""
    own = [F.floor(F.col("v")[d] / eps).cast("long") for d in range(dims)]
    ahead = [o for o in product((-1, 0, 1), repeat=dims) if o > (0,) * dims]
    spots = [F.struct(F.lit(False).alias("guest"), F.array(*own).alias("cell"))] + [
        F.struct(F.lit(True).alias("guest"), F.array(*[c - o for c, o in zip(own, off)]).alias("cell")) for off in ahead]
    rows = points.withColumn("s", F.explode(F.array(*spots))).select("*", "s.guest", "s.cell").drop("s")
    # Cells without a point of their own compare nothing.
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("guest")).alias("homes")).filter("homes > 0")
    sizes = sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    rows = rows.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("id", F.lit("block")), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o"), "second": F.col("b") > F.col("o")}).drop("o", "nb")


def _pairs(pdf: pd.DataFrame, eps: float):
    """Index arrays of the pairs within ``eps`` of one group, by strips: both
    sides of a block pair, or one block with itself; guests aren't compared
    with each other."""
    v = np.stack(pdf["v"].to_list())
    guest, first = pdf["guest"].to_numpy(bool), pdf["b"].to_numpy() == pdf["i"].to_numpy()
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    left = np.arange(len(pdf)) if same else np.flatnonzero(first)
    right = left if same else np.flatnonzero(~first)
    for lo in range(0, len(left), 256):
        a = left[lo:lo + 256]
        d = np.sqrt(((v[a][:, None] - v[right][None]) ** 2).sum(axis=-1))
        ok = (d <= eps) & ~(guest[a][:, None] & guest[right][None])
        if same:
            ok &= a[:, None] < right[None]
        x, y = np.nonzero(ok)
        if len(x):
            yield a[x], right[y], d[x, y]


def _forest(n: int, a, b) -> np.ndarray:
    """The root of each of n points under the links (a, b)."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a, b):
        x, y = root(i), root(j)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (u, v): the smallest node that
    each reaches. In every step a node takes the smallest name among its
    neighbours' and its own, and then that name's own name, until no name
    changes; only that flag reaches the driver."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = layer_table(both, "links")
    name = layer_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("node"), "root"), "names")
    while True:
        near = both.join(name.withColumnsRenamed({"node": "v", "root": "r"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("r").alias("r"))
        step = name.join(near, "node").select("node", F.least("root", "r").alias("next"), "root")
        jump = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select(
            "node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("changed"))
        name = layer_table(jump, "names")
        if name.filter("changed").isEmpty():
            return name.select("node", "root")


def clusters(points: DataFrame, eps: float, least: int, dims: int) -> DataFrame:
    """(id, cluster, core) of every point of ``points`` (id, v of ``dims``
    coordinates); a cluster is named by its smallest core id, noise is -1.

    Equal points are compared once, with their number as weight; points
    without an id or coordinates are noise. A border point joins its nearest core
    point's cluster (of equally near ones the smallest id's).
    """
    ship_package(points.sparkSession)
    whole = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dims) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c))
    all_ = layer_table(points.select(F.col("id").cast("long").alias("id"), F.when(whole, F.col("v")).alias("v")), "density-points")
    one = layer_table(all_.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "density-distinct")

    def counts(pdf):
        n, w = np.zeros(len(pdf), np.int64), pdf["w"].to_numpy()
        for a, b, _ in _pairs(pdf, eps):
            np.add.at(n, a, w[b])
            np.add.at(n, b, w[a])
        return pd.DataFrame({"id": pdf["id"], "n": n})[n > 0]

    near = cells(one, eps, dims).groupBy("cell", "i", "j").applyInPandas(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    known = layer_table(one.join(near, "id", "left").select("id", "v", (F.coalesce("n", F.lit(0)) + F.col("w") >= least).alias("core")), "density-core")

    def links(pdf):
        core, ids = pdf["core"].to_numpy(bool), pdf["id"].to_numpy()
        a_, b_, best = [], [], {}
        for a, b, d in _pairs(pdf, eps):
            both = core[a] & core[b]
            a_.append(a[both])
            b_.append(b[both])
            for x, y in ((a, b), (b, a)):
                edge = ~core[x] & core[y]
                for i, c, dist in zip(ids[x[edge]].tolist(), ids[y[edge]].tolist(), d[edge].tolist()):
                    best[i] = min(best.get(i, (dist, c)), (dist, c))
        root = _forest(len(pdf), np.concatenate(a_).tolist(), np.concatenate(b_).tolist()) if a_ else np.arange(len(pdf))
        tree = np.flatnonzero(root != np.arange(len(pdf)))
        return pd.DataFrame({"u": np.concatenate([ids[tree], np.array(list(best), np.int64)]),
                             "v": np.concatenate([ids[root[tree]], np.array([c for _, c in best.values()], np.int64)]),
                             "d": np.concatenate([np.full(len(tree), -1.0), np.array([x for x, _ in best.values()], float)])})

    found = layer_table(cells(known, eps, dims).groupBy("cell", "i", "j").applyInPandas(links, "u long, v long, d double"), "density-links")
    root = components(found.filter("d < 0"))
    core = known.filter("core").select("id").join(root.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    edge = found.filter("d >= 0").groupBy(F.col("u").alias("id")).agg(F.min(F.struct("d", "v")).alias("k")).select("id", F.col("k.v").alias("to"))
    edge = edge.join(core.withColumnRenamed("id", "to"), "to").select("id", "cluster")
    named = core.withColumn("core", F.lit(True)).unionByName(edge.withColumn("core", F.lit(False)))
    by_vec = one.select("v", F.col("id").alias("first")).join(named.withColumnRenamed("id", "first"), "first", "left")
    return all_.join(by_vec, "v", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
