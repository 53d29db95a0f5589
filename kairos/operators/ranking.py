"""Sorts, limits, snapshots and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order):
    if isinstance(order, (str, Column)):
        order = [order]
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_n(df: DataFrame, order, n: int) -> DataFrame:
    """H1: global sort + limit (planned as TakeOrderedAndProject: each task
    keeps its own top n, only n rows per task reach the final merge).
    ``order`` must end with a unique tiebreak for a deterministic result."""
    return df.orderBy(*_order(order)).limit(n)


def top_k_per_group(df: DataFrame, by, order, k: int, out="rank", salts: int = 16) -> DataFrame:
    """H2/H8: the first ``k`` rows per group by ``order``.

    Two phases so a hot group never sorts whole in one task: rows are
    spread over ``salts`` sub-groups (hash of the whole row), each keeps its
    own top ``k``, and the final ranking runs over at most ``salts * k``
    rows per group. Exact: the group's top ``k`` is inside the union.
    ``order`` must end with a unique tiebreak.
    """
    by = [by] if isinstance(by, str) else list(by)
    o = _order(order)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    df = df.withColumn("__salt", salt)
    df = df.withColumn("__r1", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*o)))
    df = df.filter(F.col("__r1") <= k).drop("__r1", "__salt")
    df = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*o)))
    return df.filter(F.col(out) <= k)


def latest_snapshot(df: DataFrame, t="dt") -> DataFrame:
    """Rows of the latest date (semi join to the 1-row max; no collect)."""
    mx = df.agg(F.max(t).alias("__mx"))
    return df.join(F.broadcast(mx), F.col(t) == F.col("__mx"), "left_semi")


def snapshot_at_offset(df: DataFrame, t="dt", days=90) -> DataFrame:
    """Rows of the first date >= max(t) - days (the last date if none)."""
    mx = df.agg(F.max(t).alias("__mx"))
    cand = df.select(t).distinct().join(F.broadcast(mx), F.col(t) >= F.date_sub(F.col("__mx"), days)) \
        .agg(F.min(t).alias("__d"))
    return df.join(F.broadcast(cand), F.col(t) == F.col("__d"), "left_semi")


def latest_per_key(df: DataFrame, k="ticker", t="dt") -> DataFrame:
    """The latest row per key (``max_by`` aggregation: combined
    map-side, so a key with many rows is never sorted whole in one task)."""
    k = [k] if isinstance(k, str) else list(k)
    rest = [c for c in df.columns if c not in k]
    g = df.groupBy(*k).agg(F.max_by(F.struct(*rest), F.col(t)).alias("__row"))
    return g.select(*k, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def lookup(df: DataFrame, k: str, v, t="dt") -> DataFrame:
    """The latest row for one key value."""
    return latest_per_key(df.filter(F.col(k) == F.lit(v)), k, t)


def nth_date(df: DataFrame, n: int, t="dt") -> DataFrame:
    """H6: rows of the n-th (0-based) distinct date, ascending."""
    d = df.select(t).distinct().withColumn("__dr", F.dense_rank().over(Window.orderBy(t)))
    d = d.filter(F.col("__dr") == n + 1).select(F.col(t).alias("__d"))
    return df.join(F.broadcast(d), F.col(t) == F.col("__d"), "left_semi")


def cap_edges(edges: DataFrame, n=2000, w="weight") -> DataFrame:
    """H4: strongest ``n`` edges by |weight| (ties by endpoints)."""
    return top_n(edges, [F.abs(F.col(w)).desc(), F.col("src"), F.col("dst")], n)


def keep_last(df: DataFrame, k, t, n=20) -> DataFrame:
    """H8: newest ``n`` rows per key; rows of one time in the order of all
    their other columns."""
    rest = [F.col(c) for c in sorted(df.columns) if c != t]
    return top_k_per_group(df, k, [F.col(t).desc(), *rest], n).drop("rank")


def global_rank(df: DataFrame, order, out="rank", name="ranked") -> DataFrame:
    """1, 2, ... over all rows by ``order`` (which must be unique). The
    rows are range-partitioned and written in order; a row's rank is its place
    in its partition plus the rows of the partitions before it (one number for
    each partition), so no task sees all rows."""
    from ..session import layer_table
    rows = layer_table(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), name)
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 1, []
    for r in sorted(counts, key=lambda r: r["p"]):
        offsets.append((r["p"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 1)], "__p long, __o long")
    return rows.join(F.broadcast(table), part == F.col("__p")).withColumn(out, F.col("__o") + at).drop("__p", "__o", "__m")
