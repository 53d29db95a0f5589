"""Merkle manifest of a dataset: content-addressed records and proofs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stage, stage

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Offsets of partitions are broadcast up to so many times 100 bytes, counted as 100 for each row and its key's own.
FEW = 50_000
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(**changed: Column) -> Column:
    return digest(*[encoded(changed.get(c, F.col(c))) for c in FIELDS])


def joined(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Inner join of sorted partitions, whatever Spark takes the sizes to be.

    It counts stored paths by their compressed bytes, a join by digest as no
    larger than the records and exploded children as one row, so it would
    broadcast far more than its threshold through the driver.
    """
    return left.join(right.hint("merge"), on)


def with_ranks(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``) inside each key and the
    key's number of rows ``n``, written once.

    Ranges of (key, order) go to partitions, so a key that holds most rows is
    spread over many; only the counts of (key, partition) meet by key.
    """
    cols = [F.col(key)] + [F.col(c).asc_nulls_first() for c in order]
    at = stage(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), f"{name}-order")
    w = Window.partitionBy(key)
    parts = stage(at.groupBy(key, "part").agg(F.count("*").alias("c"), F.min("at").alias("first")).select(
        key, "part", "first", F.sum("c").over(w).alias("n"),
        F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), f"{name}-parts")
    on, held = [key, "part"], parts.agg(F.sum(100 + F.octet_length(key).cast("long"))).first()[0] or 0
    placed = at.join(F.broadcast(parts), on) if held <= 100 * FEW else joined(at, parts, on)
    out = stage(placed.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before"), name)
    drop_stage(at)
    drop_stage(parts)
    return out


@dataclass
class Tree:
    """One tree for each key over ``nodes`` (key, rank, n, digest, carried
    columns). ``levels[h - 1]`` holds the nodes of height h: key, rank, n,
    digest, items (their children in order, at height 1 with what is carried)."""

    nodes: DataFrame
    carry: tuple
    levels: list = field(default_factory=list)

    def records(self, height: int) -> DataFrame:
        """Content-addressed records: digest -> children's digests."""
        return self.levels[height - 1].groupBy("digest").agg(F.first("items.digest").alias("children"))

    def roots(self) -> DataFrame:
        """(key, n, digest) of each key's last node."""
        out = self.nodes.filter("n = 1").select("key", "n", "digest")
        for h, level in enumerate(self.levels, 1):
            out = out.unionByName(level.filter(F.col("n") <= FAN ** h).select("key", "n", "digest"))
        return out


def grow(nodes: DataFrame, carry: tuple, name: str) -> Tree:
    """While a key has several nodes, every FAN consecutive ones become the
    digest of their digests. A group has at most FAN rows, however many rows
    its key has."""
    tree = Tree(nodes, carry)
    most = nodes.agg(F.max("n")).first()[0] or 0
    cur, size = nodes, 1
    while size < most:
        item = F.struct("rank", "digest", *(carry if size == 1 else ()))
        level = cur.filter(F.col("n") > size).groupBy("key", F.shiftright("rank", 4).alias("up")).agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
        level = level.select("key", F.col("up").alias("rank"), "n", "items", digest(F.concat_ws("", "items.digest")).alias("digest"))
        tree.levels.append(stage(level, f"{name}-level"))
        cur, size = tree.levels[-1].select("key", "rank", "n", "digest"), size * FAN
    return tree


def _chosen(children: str, pos: str) -> Column:
    """The unselected children, left and right of the selected one."""
    c, i = F.col(children), F.col(pos)
    return F.struct(F.concat_ws("", F.slice(c, 1, i)).alias("left"), F.concat_ws("", F.slice(c, i + 2, FAN)).alias("right"))


def descend(starts: DataFrame, tree: Tree, keep: tuple) -> DataFrame:
    """All leaf requests of ``starts`` (key, n, digest, path, kept columns)
    go down from the root: a node's record is looked up by its digest, the
    rank's next digit selects a child and the others are added to the path.

    Requests of one node travel as one row until its last level, so a path is
    held once for FAN leaves. Returns the carried and kept columns and
    ``path``, segments from the root to the leaf.
    """
    cols = ["key", "rank", "n", "digest", "path", *keep]
    starts = starts.withColumn("rank", F.lit(0).cast("long")).select(*cols)
    lone = joined(starts.filter("n = 1").drop("n", "digest", "rank"), tree.nodes.filter("n = 1").select("key", *tree.carry), "key")
    done = [lone.select(*tree.carry, *keep, "path")]
    front = None
    for h in range(len(tree.levels), 0, -1):
        here = starts.filter((F.col("n") > FAN ** (h - 1)) & (F.col("n") <= FAN ** h))
        here = here if front is None else front.unionByName(here)
        found = joined(here, tree.records(h), "digest")
        if h > 1:
            found = found.select("*", F.posexplode("children").alias("pos", "child"))
            front = found.select("key", (F.shiftleft("rank", 4) + F.col("pos")).alias("rank"), "n", F.col("child").alias("digest"),
                                 F.concat("path", F.array(_chosen("children", "pos"))).alias("path"), *keep)
            continue
        asked = tree.levels[0].select("key", "rank", "items")
        found = joined(found.drop("n", "digest"), asked, ["key", "rank"]).select("path", "children", *keep, F.posexplode("items").alias("pos", "item"))
        done.append(found.select(*[F.col(f"item.{c}").alias(c) for c in tree.carry], *keep, F.concat("path", F.array(_chosen("children", "pos"))).alias("path")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def siblings(path: Column) -> Column:
    """The proof: unselected digests from the leaf's level up to the root."""
    return F.concat_ws("", F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(F.reverse(path), leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def manifest(leaves: DataFrame, carry: tuple = ()) -> tuple[Tree, Tree]:
    """Trees over ``leaves`` (source, doc_id, leaf, carried columns): one for
    each source by ascending doc_id, and one over the sources' roots (null
    source first, else by UTF-8 bytes). Rows of one doc_id stand in order of
    their digests; null ids come first."""
    # Null sorts before every source: "n" < "s...".
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = leaves.select(key.alias("key"), F.col("leaf").alias("digest"), "doc_id", *[c for c in carry if c != "doc_id"])
    below = grow(with_ranks(rows, "key", ["doc_id", "digest"], "leaf-ranks"), carry, "subtree")
    tops = stage(below.roots(), "subroots").select(
        F.lit("t").alias("key"), "digest", F.col("key").alias("part_key"), F.col("n").alias("part_n"), F.col("digest").alias("part_digest"))
    above = grow(with_ranks(tops, "key", ["part_key"], "root-ranks"), ("part_key", "part_n", "part_digest"), "tree")
    return below, above


def report(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that follows
    from its tampered copy (where 5 divides the crc32 of the id, A-Z of the
    text are lower-cased) and the original siblings.

    A null field counts as ``-``; a null id is never tampered; rows that repeat
    are leaves of their own; a source of one row has its leaf as subroot; a
    table of one row has its leaf as root; an empty table gives an empty
    result; only the five fields are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in FIELDS[1:]])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (F.col("text") != ascii_lower(F.col("text")))
    leaves = stage(rows.select("source", "doc_id", leaf_of().alias("leaf"),
                               F.when(hit, leaf_of(text=ascii_lower(F.col("text")))).alias("tampered")), "leaves")
    below, above = manifest(leaves.withColumn("own", F.col("leaf")), ("doc_id", "own", "tampered"))
    drop_stage(leaves)
    begin = above.roots().select("key", "n", "digest", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    parts = descend(begin, above, ("root",)).select(
        F.col("part_key").alias("key"), F.col("part_n").alias("n"), F.col("part_digest").alias("digest"),
        F.col("part_digest").alias("subroot"), "root", "path")
    rows = descend(stage(parts, "requests"), below, ("subroot", "root"))
    out = rows.select("doc_id", F.col("own").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
                      folded(F.coalesce("tampered", "own"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, doc_id, source, text,
        concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR END,
               CASE WHEN source IS NULL THEN '-' ELSE strlen(source)::VARCHAR || ':' || source END,
               CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang)::VARCHAR || ':' || lang END,
               CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR END) AS head,
        list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
            lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) AS crc
      FROM documents),
h AS (SELECT rid, doc_id, source,
        sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE strlen(text)::VARCHAR || ':' || text END)) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 5 = 0 AND text IS NOT NULL THEN
          sha256(concat(head, strlen(text)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))
        END AS tampered FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rk,
             count(*) OVER (PARTITION BY source) AS n FROM h),
sub(source, lvl, rk, n, digest) AS (
  SELECT source, 0::BIGINT, rk, n, leaf FROM leaves
  UNION ALL
  SELECT source, lvl + 1, rk >> 4, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY rk)) FROM sub WHERE n > 1 GROUP BY source, lvl, rk >> 4),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rk, count(*) OVER () AS n FROM sub WHERE n = 1),
top(lvl, rk, n, digest) AS (
  SELECT 0::BIGINT, rk, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, rk >> 4, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY rk)) FROM top WHERE n > 1 GROUP BY lvl, rk >> 4),
around AS (
  SELECT l.rid, s.lvl AS step, s.rk, s.digest, l.rk >> (4 * s.lvl) AS own FROM leaves l
    JOIN sub s ON s.source IS NOT DISTINCT FROM l.source AND s.n > 1 AND s.rk >> 4 = l.rk >> (4 * s.lvl + 4)
  UNION ALL
  SELECT l.rid, 100 + t.lvl, t.rk, t.digest, r.rk >> (4 * t.lvl) FROM leaves l
    JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN top t ON t.n > 1 AND t.rk >> 4 = r.rk >> (4 * t.lvl + 4)),
seg AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, lefts, rights FROM (
  SELECT rid, step, coalesce(string_agg(digest, '' ORDER BY rk) FILTER (rk < own), '') AS lefts,
         coalesce(string_agg(digest, '' ORDER BY rk) FILTER (rk > own), '') AS rights FROM around GROUP BY rid, step) AS g),
proof AS (SELECT rid, max(k) AS m, string_agg(lefts || rights, '' ORDER BY k) AS sibs FROM seg GROUP BY rid),
fold(rid, k, cur) AS (
  SELECT rid, 0::BIGINT, coalesce(tampered, leaf) FROM leaves
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(concat(s.lefts, f.cur, s.rights)) FROM fold f JOIN seg s ON s.rid = f.rid AND s.k = f.k + 1)
SELECT l.doc_id, l.leaf, r.digest AS subroot, t.digest AS root, sha256(coalesce(p.sibs, '')) AS proof_sha256,
       f.cur AS folded_root, f.cur = t.digest AS verified
FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN top t ON t.n = 1
LEFT JOIN proof p ON p.rid = l.rid JOIN fold f ON f.rid = l.rid AND f.k = coalesce(p.m, 0)"""
