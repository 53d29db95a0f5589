"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, stage

SEED = "mix-1"


def word_count(text):
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, col: str) -> DataFrame:
    """``sources`` (one row each) with ``rank``: its place by code point, null
    last. A range-partitioned sort with one offset for each partition; no
    task sees all sources."""
    rows = stage(sources.orderBy(F.col(col).asc_nulls_last()).withColumn("__m", F.monotonically_increasing_id()), "sources")
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()  # one row for each partition
    before, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["p"]):
        offsets.append((r["p"], before))
        before += r["c"]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__p long, __o long")
    return rows.join(F.broadcast(table), part == F.col("__p")).select(
        *[c for c in sources.columns], (F.col("__o") + at).alias("rank"))


def targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code point order. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight,
    again until none is above. Each round is one aggregate of two sums; the
    set of full sources only grows, so rounds end when it stays.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = stage(ranked(sizes, "source").withColumn("w", w.cast("long")), "weights")
    total, weight = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    full = F.lit(False)
    held = (0, 0)
    for _ in range(1000):
        left, of = total - held[0], weight - held[1]
        if of <= 0:
            break
        share = F.col("w") * F.lit(left).cast("double") / F.lit(of).cast("double")
        full = F.col("source_size") * most <= share
        now = src.filter(full).agg(F.coalesce(F.sum(F.col("source_size") * most), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if tuple(now) == held:
            break
        held = tuple(now)
    else:
        raise RuntimeError("targets did not settle")
    share = F.col("w") * F.lit(total - held[0]).cast("double") / F.lit(max(weight - held[1], 1)).cast("double")
    full = F.col("source_size") * most <= share if weight > held[1] else F.lit(True)
    return src.select("source", "source_size", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def copies(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
           weights=(1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    A source's rate is target / size; each row is emitted floor(rate) times,
    and once more if md5(seed, doc_id) as a fraction is below the rate's
    fraction, so reruns and retried tasks agree. Rows of a source without
    words have rate 0; a null text has size 0, a null source is a source of
    its own, null ids draw alike.
    """
    sized = docs.withColumn("__size", word_count(F.col(text_col).cast("string")))
    sums = sized.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum("__size").alias("source_size"))
    t = targets(sums, weights, most).select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"),
                                            F.col("target").alias("__target"))
    t = stage(t, "targets")
    if t.count() <= 100_000:  # counted bound; beyond it the planner joins by shuffle and splits large sources
        t = F.broadcast(t)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10)
    draw = draw.cast("double") / F.lit(float(1 << 52))
    more = F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return sized.join(t, F.col(source_col).cast("string").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn(
        "__copies", (F.floor(rate) + more).cast("long"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; an empty table
    gives an empty result. Columns other than the three named are not read."""
    cols = [options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]
    return copies(docs.select(*cols), **options).select(
        F.col(cols[0]).cast("long").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, columns unchanged,
    whatever their names: rows travel as one struct beside the mix's columns."""
    cols = [options.pop(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(cols, ("doc_id", "text", "source"))], F.struct("*").alias("row"))
    out = copies(rows, **options).filter("__copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
k AS (SELECT *, sum(3 * source_size) OVER o AS cap_before, sum(w) OVER o AS w_before,
             (SELECT sum(source_size) FROM r) AS total, (SELECT sum(w) FROM r) AS wt
      FROM r WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size <= CAST(w AS DOUBLE) * CAST(total - coalesce(cap_before, 0) AS DOUBLE) / CAST(wt - coalesce(w_before, 0) AS DOUBLE) AS is_full FROM k),
held AS (SELECT coalesce(sum(3 * source_size) FILTER (WHERE is_full), 0) AS c, coalesce(sum(w) FILTER (WHERE is_full), 0) AS hw FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
             ELSE CAST(w AS DOUBLE) * CAST(total - c AS DOUBLE) / CAST(wt - hw AS DOUBLE) END AS target FROM f, held),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE CAST(0 AS DOUBLE) END AS rate,
             CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x"""
