"""Louvain communities by joins and aggregates.

A round moves many nodes at once without their gains disturbing each other: a
node's best move is carried out only if no better one touches the community it
leaves or the one it joins. So the gains of a round add up and modularity never
falls; the best move of all is always among them, so rounds end. After a few
rounds communities become nodes of a smaller graph, and the work goes on there
until a whole level has no move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import layer_table

DIGITS = 12  # gains are compared after rounding: the order of sums must not choose


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): both directions summed by pair; a self loop counts twice."""
    e = edges.select("src", "dst", F.abs("weight").cast("double").alias("w")).filter("w > 0")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def moves(adj: DataFrame, nodes: DataFrame, total: float) -> DataFrame:
    """(node, comm): the moves of one round. ``nodes``: node, comm, k."""
    tot = nodes.groupBy("comm").agg(F.sum("k").alias("tot"))
    at = nodes.select(F.col("node").alias("dst"), F.col("comm").alias("to"))
    links = adj.filter("src <> dst").join(at, "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("links"))
    x = links.join(nodes, "node").join(tot.withColumnsRenamed({"comm": "to", "tot": "tot_to"}), "to").join(
        tot.withColumnRenamed("tot", "tot_own"), "comm")
    own = links.join(nodes, "node").filter(F.col("to") == F.col("comm")).select("node", F.col("links").alias("links_own"))
    x = x.filter(F.col("to") != F.col("comm")).join(own, "node", "left").fillna(0.0, ["links_own"])
    gain = 2 * (F.col("links") - F.col("links_own")) / total - 2 * F.col("k") * (F.col("tot_to") - F.col("tot_own") + F.col("k")) / total ** 2
    x = x.select("node", "comm", "to", F.round(gain, DIGITS).alias("gain")).filter("gain > 0")
    # Largest gain, then smallest name: min of (-gain, name) combines map-side.
    best = x.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), F.col("to"), F.col("comm"))).alias("b")).select(
        "node", "b.loss", "b.to", "b.comm")
    touch = best.select(F.col("comm").alias("c"), F.struct("loss", "node").alias("rank")).unionByName(
        best.select(F.col("to").alias("c"), F.struct("loss", "node").alias("rank")))
    first = touch.groupBy("c").agg(F.min("rank").alias("r")).select("c", F.col("r.node").alias("winner"))
    return best.join(first.withColumnsRenamed({"c": "comm", "winner": "w1"}), "comm").join(
        first.withColumnsRenamed({"c": "to", "winner": "w2"}), "to").filter("node = w1 AND node = w2").select("node", F.col("to").alias("new"))


def modularity(adj: DataFrame, comm: DataFrame) -> float:
    """Of the communities (node, comm); one number reaches the driver."""
    total = adj.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    a = adj.join(comm.withColumnsRenamed({"node": "src", "comm": "c1"}), "src").join(comm.withColumnsRenamed({"node": "dst", "comm": "c2"}), "dst")
    inside = a.groupBy(F.col("c1").alias("comm")).agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("t"))
    return inside.agg(F.sum(F.col("i") / total - (F.col("t") / total) ** 2)).first()[0]


def louvain(nodes: DataFrame, edges: DataFrame, id_: str = "ticker", rounds: int = 8, trace: list | None = None) -> DataFrame:
    """(node, comm) of every node; a community is named by its smallest node.

    ``edges`` (src, dst, weight) are undirected, weights count by size; at most
    ``rounds`` rounds go before the graph is made smaller, and the work ends
    when a level has no move at all, so the result does not depend on a fixed
    number of levels. Nodes without edges stay alone. ``trace`` gets the
    modularity after each round.
    """
    names = nodes.select(F.col(id_).alias("node")).distinct()
    base = layer_table(adjacency(edges).join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(
        names.withColumnRenamed("node", "dst"), "dst", "left_semi"), "louvain-edges")
    total = base.agg(F.sum("w")).first()[0] or 0.0
    top = layer_table(names.withColumn("comm", F.col("node")), "louvain-comm")  # original node -> node of the present level
    adj = base
    while total:
        state = layer_table(adj.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("comm", F.col("node")), "louvain-state")
        moved = False
        for _ in range(rounds):
            step = layer_table(moves(adj, state, total), "louvain-moves")
            if step.isEmpty():
                break
            moved = True
            state = layer_table(state.join(step, "node", "left").select("node", "k", F.coalesce("new", "comm").alias("comm")), "louvain-state")
            if trace is not None:
                trace.append(modularity(adj, state.select("node", "comm")))
        if not moved:
            break
        into = state.select("node", "comm")
        top = layer_table(top.withColumnRenamed("comm", "mid").join(into.withColumnsRenamed({"node": "mid", "comm": "up"}), "mid", "left").select(
            "node", F.coalesce("up", "mid").alias("comm")), "louvain-comm")
        adj = layer_table(adj.join(into.withColumnsRenamed({"node": "src", "comm": "a"}), "src").join(
            into.withColumnsRenamed({"node": "dst", "comm": "b"}), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(
            F.sum("w").alias("w")), "louvain-edges")
    name = top.groupBy("comm").agg(F.min("node").alias("name"))
    return top.join(name, "comm").select("node", F.col("name").alias("comm"))
