"""Correlation graph operators.

Nodes are instruments, edges are correlation pairs (src < dst). Correlations
come from Gram matrices of instrument blocks, never from a self join
that emits every pair of instruments of every date. Graph walks (BFS,
PageRank, communities) are iterations of join + aggregate whose state is
written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div
from ..session import layer_table, materialize, ship_package
from .louvain import louvain

PAIRS = "src string, dst string, n long, corr double"


def _gram(pdf, t, v, min_overlap, pos, neg):
    """The pairs of one instrument block with another (or with itself): dense
    dates x instruments matrices of both, products of them, one row for each
    pair that stays."""
    import numpy as np
    import pandas as pd
    days, row = np.unique(pdf[t].to_numpy(), return_inverse=True)
    left = pdf["side"].to_numpy() == 0
    same = bool(pdf["same"].iloc[0])

    def dense(part):
        names, col = np.unique(pdf["key"].to_numpy()[part].astype(str), return_inverse=True)
        x, m = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        x[row[part], col], m[row[part], col] = pdf[v].to_numpy(float)[part], 1.0
        return names, x, m

    a, x, mx = dense(left)
    b, y, my = (a, x, mx) if same else dense(~left)
    n, sx, sy = mx.T @ my, x.T @ my, mx.T @ y
    cov = n * (x.T @ y) - sx * sy
    vx, vy = n * ((x * x).T @ my) - sx * sx, n * (mx.T @ (y * y)) - sy * sy
    ok = (n >= max(1, min_overlap)) & (vx > 0) & (vy > 0)
    if same:
        ok &= np.triu(np.ones_like(ok), 1).astype(bool)
    i, j = np.nonzero(ok)
    corr = cov[i, j] / (np.sqrt(vx[i, j]) * np.sqrt(vy[i, j]))
    if pos is not None:
        keep = (corr >= pos) | (corr <= neg)
        i, j, corr = i[keep], j[keep], corr[keep]
    swap = a[i] > b[j]  # orient every pair as src < dst
    return pd.DataFrame({"src": np.where(swap, b[j], a[i]), "dst": np.where(swap, a[i], b[j]), "n": n[i, j].astype("int64"), "corr": corr})


def _blocked(x: DataFrame, key, t, v, min_overlap, block, pos=None, neg=None) -> DataFrame:
    """Correlations of all instrument pairs of ``x`` by blocks of instruments:
    each pair of blocks is one group, of the dates of ``2 * block`` instruments
    at most (by hash; about as many). Values go once to each group of their
    block. With thresholds only pairs beyond them leave a group."""
    ship_package(x.sparkSession)
    nb = max(1, -(-x.select(key).distinct().count() // block))
    rows = x.select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(v).cast("double").alias("v")).dropDuplicates(["key", "t"])
    rows = rows.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(nb)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    rows = rows.select("key", "t", "v", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
                       (F.col("b") > F.col("o")).cast("int").alias("side"), (F.col("b") == F.col("o")).alias("same"))
    return rows.groupBy("i", "j").applyInPandas(lambda pdf: _gram(pdf, "t", "v", min_overlap, pos, neg), PAIRS)


def correlation_pairs(df: DataFrame, key="ticker", t="dt", v="daily_return", min_obs=60, min_overlap=2, block=256, pos=None, neg=None) -> DataFrame:
    """G1: Pearson correlation of every instrument pair over their common
    dates, for instruments with >= ``min_obs`` values.

    Two-dimensional blocks of instruments (``block`` wide) are worked on by
    themselves, so memory is bounded by a block and the calendar; with ``pos``
    and ``neg`` only pairs with corr >= pos or <= neg are ever written.
    """
    x = df.select(key, t, v).filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    counts = x.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_obs)
    return _blocked(x.join(counts.select(key), key, "left_semi"), key, t, v, min_overlap, block, pos, neg)


def tail_correlation(df: DataFrame, n=120, min_n=60, key="ticker", t="dt", v="daily_return", block=256) -> DataFrame:
    """Correlation of the last ``n`` values of each instrument aligned by
    position from the end (not by date); |corr| kept."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(t).desc()))
    x = df.select(key, t, v).filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).withColumn("__pos", r).filter(F.col("__pos") <= n)
    cnt = x.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") >= min_n)
    pairs = _blocked(x.join(cnt.select(key), key, "left_semi"), key, "__pos", v, 2, block)
    return pairs.withColumn("corr", F.abs("corr"))


def correlation_edges(pairs: DataFrame, pos=0.5, neg=-0.3, kind="signed") -> DataFrame:
    """Edges from pairs. ``signed``: corr >= pos positive, <= neg
    negative; ``abs``: |corr| >= pos, typed by sign."""
    c = F.col("corr")
    if kind == "abs":
        e = pairs.filter(F.abs(c) >= pos)
    else:
        e = pairs.filter((c >= pos) | (c <= neg))
    return e.select("src", "dst", c.alias("weight"),
                    F.when(c >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("edge_type"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Adjacency: every undirected edge in both directions."""
    e = edges.select("src", "dst", "weight", "edge_type")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_type"))


def degree(nodes: DataFrame, edges: DataFrame, id_="ticker") -> DataFrame:
    """Degree centrality over positive edges / (n-1), and all-edge count."""
    adj = both_directions(edges)
    deg = adj.groupBy(F.col("src").alias(id_)).agg(
        F.count_if(F.col("edge_type") == "positive").alias("pos_degree"), F.count(F.lit(1)).alias("edge_count"))
    n = nodes.select(id_).distinct()
    out = n.join(deg, id_, "left").fillna({"pos_degree": 0, "edge_count": 0})
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return out.withColumn("degree_centrality", div(F.col("pos_degree").cast("double"), total - 1))


def propagate_shock(edges: DataFrame, sources: DataFrame, decay=0.6, max_hops=5, min_impact=0.001) -> DataFrame:
    """BFS shock propagation from one or many sources at once.

    ``sources``: (source, magnitude). Hop by hop: frontier x adjacency,
    impact = parent * |corr| * decay (sign flipped on negative edges), drop
    |impact| < min_impact and nodes already reached from that source; per
    (source, node) keep the largest |impact| (tie: smallest parent). The
    result per node is the largest |impact| over sources. Bounded loop of
    ``max_hops`` joins; each hop's frontier is small (one row per node).
    """
    adj = materialize(both_directions(edges).select("src", "dst", "weight"))
    front = sources.select(F.col("source"), F.col("source").alias("node"), F.col("magnitude").alias("impact"),
                           F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"))
    reached = front
    for hop in range(1, max_hops + 1):
        cand = front.join(adj, front.node == adj.src).select(
            "source", F.col("dst").alias("node"), (F.col("impact") * F.abs("weight") * F.lit(decay)
                                                  * F.when(F.col("weight") < 0, -1.0).otherwise(1.0)).alias("impact"),
            F.lit(hop).alias("hop"), F.col("node").alias("parent"))
        cand = cand.filter(F.abs("impact") >= min_impact)
        cand = cand.join(reached.select("source", "node"), ["source", "node"], "left_anti")
        best = Window.partitionBy("source", "node").orderBy(F.abs("impact").desc(), F.col("parent"))
        front = materialize(cand.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r"))
        reached = materialize(reached.unionByName(front))
    w = Window.partitionBy("node").orderBy(F.abs("impact").desc(), F.col("source"))
    return reached.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def intensity_shock(edges: DataFrame, source: str, max_depth=8, stop=0.05, factor=0.5, damp=0.8) -> DataFrame:
    """Intensity BFS: next = cur * (1 - factor |w|) * damp; nodes below
    ``stop`` or deeper than ``max_depth`` do not expand; first reach wins
    (per level the largest intensity, tie: smallest parent)."""
    spark = edges.sparkSession
    adj = materialize(both_directions(edges).select("src", "dst", "weight"))
    front = spark.createDataFrame([(source, 1.0, 0)], "node string, intensity double, depth int")
    reached = front
    for d in range(1, max_depth + 2):
        grow = front.filter((F.col("intensity") >= stop) & (F.col("depth") <= max_depth))
        cand = grow.join(adj, grow.node == adj.src).select(
            F.col("dst").alias("node"),
            (F.col("intensity") * (F.lit(1.0) - F.abs("weight") * F.lit(factor)) * F.lit(damp)).alias("intensity"),
            F.lit(d).alias("depth"), F.col("node").alias("parent"))
        cand = cand.join(reached.select("node"), "node", "left_anti")
        best = Window.partitionBy("node").orderBy(F.col("intensity").desc(), F.col("parent"))
        front = materialize(cand.withColumn("__r", F.row_number().over(best)).filter("__r = 1")
                            .drop("__r", "parent"))
        reached = materialize(reached.unionByName(front))
    return reached


def apply_shock(df: DataFrame, shocked: DataFrame, source: str, kind="crash", id_="ticker") -> DataFrame:
    """Shift the direction bias of reached instruments (not the source)
    by intensity: crash -> short +0.15i, put +0.10i (max 0.8), buy -0.15i,
    call -0.10i (min 0.05); rally the other way; then renormalise to 1."""
    j = df.join(shocked.select(F.col("node").alias(id_), F.col("intensity").alias("__i")), id_, "left")
    hit = F.col("__i").isNotNull() & (F.col(id_) != F.lit(source))
    i = F.col("__i")
    up, dn = (("short_pct", "put_pct"), ("buy_pct", "call_pct")) if kind == "crash" else \
        (("buy_pct", "call_pct"), ("short_pct", "put_pct"))
    new = {up[0]: F.least(F.lit(0.8), F.col(up[0]) + i * 0.15), up[1]: F.least(F.lit(0.8), F.col(up[1]) + i * 0.10),
           dn[0]: F.greatest(F.lit(0.05), F.col(dn[0]) - i * 0.15),
           dn[1]: F.greatest(F.lit(0.05), F.col(dn[1]) - i * 0.10)}
    j = j.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})
    tot = F.col("buy_pct") + F.col("call_pct") + F.col("put_pct") + F.col("short_pct")
    j = j.withColumn("__t", tot)
    return j.withColumns({k: F.when(hit, F.col(k) / F.col("__t")).otherwise(F.col(k))
                          for k in ("buy_pct", "call_pct", "put_pct", "short_pct")}).drop("__i", "__t")


def pagerank(nodes: DataFrame, edges: DataFrame, iters=20, d=0.85, id_="ticker", checkpoint_every=1) -> DataFrame:
    """Weighted PageRank (|weight| as transition weight), fixed number
    of iterations, dangling mass spread evenly. Scalars (node count,
    dangling mass) are windows over the node table (one row per node), not
    driver values or cross joins. Each step reads the previous ranks twice,
    so ranks are checkpointed every iteration: the plan stays one step
    deep instead of doubling per step."""
    adj = materialize(both_directions(edges).select("src", "dst", F.abs("weight").alias("w")))
    out_w = adj.groupBy("src").agg(F.sum("w").alias("out_w"))
    adj = materialize(adj.join(out_w, "src").select("src", "dst", (F.col("w") / F.col("out_w")).alias("p")))
    allw = Window.partitionBy()
    rank = nodes.select(F.col(id_).alias("node")).distinct() \
        .join(out_w.select(F.col("src").alias("node"), F.lit(True).alias("has_out")), "node", "left") \
        .withColumn("N", F.count(F.lit(1)).over(allw))
    rank = materialize(rank.withColumn("rank", F.lit(1.0) / F.col("N")))
    for i in range(iters):
        contrib = rank.join(adj, rank.node == adj.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("c"))
        rank = rank.join(contrib, rank.node == contrib.dst, "left").withColumn(
            "dm", F.sum(F.when(F.col("has_out").isNull(), F.col("rank")).otherwise(F.lit(0.0))).over(allw))
        rank = rank.select("node", "has_out", "N", (F.lit(1.0 - d) / F.col("N") + F.lit(d) * (
            F.coalesce("c", F.lit(0.0)) + F.col("dm") / F.col("N"))).alias("rank"))
        if checkpoint_every and (i + 1) % checkpoint_every == 0:
            rank = materialize(rank)
    return rank.select(F.col("node").alias(id_), F.col("rank").alias("pagerank"))


def eigenvector(nodes: DataFrame, edges: DataFrame, iters=100, id_="ticker", tol=1e-9) -> DataFrame:
    """Eigenvector centrality by power iteration on (A + I) with |weight|,
    L2-normalised each step, until no entry changes by more than ``tol`` (or
    after ``iters`` steps). Norm and change are one number each."""
    adj = layer_table(both_directions(edges).select("src", "dst", F.abs("weight").alias("w")), "eigen-edges")
    x = layer_table(nodes.select(F.col(id_).alias("node")).distinct().withColumns({"x": F.lit(1.0), "y": F.lit(1.0)}), "eigen")
    for _ in range(iters):
        ax = x.join(adj, x.node == adj.src).groupBy("dst").agg(F.sum(F.col("x") * F.col("w")).alias("ax"))
        y = layer_table(x.join(ax, x.node == ax.dst, "left").select("node", "x", (F.col("x") + F.coalesce("ax", F.lit(0.0))).alias("y")), "eigen")
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        if not norm:
            break
        change = y.agg(F.max(F.abs(F.col("y") / norm - F.col("x")))).first()[0]
        x = y.select("node", (F.col("y") / norm).alias("x"), "y")
        if change <= tol:
            break
    return x.select(F.col("node").alias(id_), F.col("x").alias("eigenvector"))


def communities(nodes: DataFrame, edges: DataFrame, id_="ticker") -> DataFrame:
    """Louvain communities over positive edges, with their sizes."""
    comm = louvain(nodes, edges.filter(F.col("edge_type") == "positive"), id_)
    sizes = comm.groupBy("comm").agg(F.count(F.lit(1)).alias("community_size"))
    return comm.join(sizes, "comm").select(F.col("node").alias(id_), F.col("comm").alias("community"), "community_size")


def community_sectors(comm: DataFrame, nodes: DataFrame, id_="ticker") -> DataFrame:
    """Instruments of each sector in each community."""
    return comm.join(nodes.select(id_, "sector"), id_).groupBy("community", "sector").agg(F.count(F.lit(1)).alias("n"))


def network_stats(nodes: DataFrame, edges: DataFrame, id_="ticker") -> DataFrame:
    """Node and edge counts, mean connections and density."""
    n = nodes.select(id_).distinct().agg(F.count(F.lit(1)).alias("node_count"), F.lit(1).alias("__k"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"), F.lit(1).alias("__k"))
    j = n.join(e, "__k").drop("__k")
    nn = F.col("node_count").cast("double")
    return j.withColumns({"avg_connections": div(F.col("edge_count") * 2.0, nn),
                          "density": div(F.col("edge_count").cast("double"), nn * (nn - 1) / 2.0)})


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Neighbours of one node with weight, strongest first."""
    adj = both_directions(edges).filter(F.col("src") == node)
    return adj.select(F.col("dst").alias("neighbour"), "weight", "edge_type")


def filter_edges_by_vol(edges: DataFrame, nodes: DataFrame, mode="highVol", vol="vol_percentile",
                        id_="ticker") -> DataFrame:
    """Keep edges whose mean endpoint volatility is > 0.6 (highVol) or
    <= 0.4 (lowVol); a missing endpoint counts 0.5."""
    v = nodes.select(F.col(id_).alias("__id"), F.col(vol).alias("__v"))
    j = edges.join(v.withColumnsRenamed({"__id": "__a", "__v": "__va"}), F.col("src") == F.col("__a"), "left") \
        .join(v.withColumnsRenamed({"__id": "__b", "__v": "__vb"}), F.col("dst") == F.col("__b"), "left")
    avg = (F.coalesce("__va", F.lit(0.5)) + F.coalesce("__vb", F.lit(0.5))) / 2.0
    cond = avg > 0.6 if mode == "highVol" else avg <= 0.4
    return j.filter(cond).select(*edges.columns)
