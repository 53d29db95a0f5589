"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step. Large: every larger neighbour of ``u`` is linked to the
    least of ``u`` and its neighbours. Small: so are ``u`` and its smaller
    neighbours. Edges hold u > v."""
    if small:
        pairs = edges
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        both = pairs.join(least, "u")
        out = both.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    else:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return out.distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the least
    node of the component.

    Alternating large and small stars: the number of rounds grows with the
    logarithm of the component's size. Each round is a written table, so
    lineage stays short; a hub's rows are joined as rows (adaptive execution
    splits them) and never gathered. No edges: no rows. ``rounds`` is a
    guard: an unconverged result raises.
    """
    cur = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .filter("u <> v").distinct(), "edges")
    state = _state(cur)
    for _ in range(rounds):
        if not state["n"]:
            break
        nxt = stage(_star(_star(cur, small=False), small=True), "edges")
        was, state = state, _state(nxt)
        drop_stage(cur)
        cur = nxt
        if was == state:
            break
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
