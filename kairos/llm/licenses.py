"""License scan: MinHash bands retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, placed, stage
from .license_texts import SHORT, TEXTS

SHINGLE = 5  # words
LEAST = 0.8  # containment of a match
WINDOW = 16  # shingles of a window
HALF = WINDOW // 2  # text windows begin at every so many shingles
LONG = 2 * WINDOW  # a template of so many shingles is looked for by windows
INSIDE = 2_000  # so many counted keys of one kind are looked for inside each row
MISS = 1e-3  # accepted chance that the bands miss a window as alike as LEAST allows

# License notices looked for.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions"),
    *SHORT,
    *TEXTS,
)
_DROPPED = ".,;:()\"'"


def bands_for(least: float = LEAST, miss: float = MISS) -> int:
    """One-value bands needed so that a window with containment ``least`` in a
    template window of its size (Jaccard least / (2 - least)) shares a band
    value with probability 1 - ``miss``: (1 - J)^bands <= miss."""
    return math.ceil(math.log(miss) / math.log(1 - least / (2 - least)))


def template_table(spark: SparkSession, notices=NOTICES) -> DataFrame:
    return spark.createDataFrame(list(notices), "template string, text string")


def tokens(text: Column) -> Column:
    """Words, lower-cased (A-Z), without the marks ``.,;:()"'``."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + _DROPPED, LOWER)
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, k: int, make) -> Column:
    """``make`` of each run of k words. Words are taken by index: ``slice``
    copies the whole array every time."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: make([F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, runs)


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order."""
    return F.coalesce(_runs(words, k, lambda w: F.xxhash64(*w)), F.array().cast("array<long>"))


def shingle_texts(words: Column, k: int) -> Column:
    return F.coalesce(_runs(words, k, lambda w: F.concat_ws(" ", *w)), F.array().cast("array<string>"))


def _by_length(words: Column, make) -> Column:
    """``make(words, k)`` with k = SHINGLE or, for fewer words, all of them."""
    out = make(words, SHINGLE)
    for k in range(1, SHINGLE):
        out = F.when(F.size(words) == k, make(words, k)).otherwise(out)
    return out


def band_values(window: Column, bands: int) -> Column:
    """The ``bands`` least hashes of a window, one band each (MinHash by a
    bottom sketch: one hash function instead of ``bands``).

    Of the union of two windows with Jaccard J, each of the ``bands`` least
    hashes is among the least ones of whichever window has it; it is in both
    with probability J, drawn without putting back. So windows share no value
    with probability (1 - J)^bands at most."""
    return F.slice(F.sort_array(F.array_distinct(window)), 1, bands)


def _at(hashes: Column, start) -> Column:
    """The window of WINDOW shingles that begins at ``start``. Hashes are taken
    by index: ``slice`` copies the whole array every time."""
    return F.array(*[F.get(hashes, start + j) for j in range(WINDOW)])


def window_values(hashes: Column, step: int, bands: int) -> Column:
    """Band values of windows every ``step`` shingles, the last one at the end."""
    last = F.size(hashes) - WINDOW
    inner = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: band_values(_at(hashes, i), bands))
    return F.when(last >= 0, F.concat(F.flatten(inner), band_values(_at(hashes, last), bands)))


def _tagged(values: Column, kind: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, template, shingles, matched, containment of every template found.

    Texts are cut into word shingles (``SHINGLE`` words; a shorter template is
    one shingle, its whole word sequence). Templates of at least ``LONG``
    shingles are retrieved by MinHash bands of overlapping windows: template
    windows begin at every shingle, text windows every HALF, so an occurrence
    holds at least two whole text windows that template windows equal but for
    its edits. Shorter templates use windows of one shingle, whose MinHash
    is its hash. Retrieved pairs are verified by exact shingle containment
    (shared distinct shingles over the template's) of at least ``least``.

    Null, empty and short texts match nothing; templates without words are
    left out; repeated rows and repeated templates give repeated results; null
    ids stay; an empty table gives an empty result; other columns are not
    read. ``templates`` (template, text) is a bounded table, its bands are
    broadcast only after they were counted.
    """
    bands = bands_for(least)
    t = templates.select(F.monotonically_increasing_id().alias("tid"), "template", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
    t = t.withColumn("k", F.least(F.lit(SHINGLE), F.size("words")))
    t = t.withColumn("hashes", _by_length(F.col("words"), shingles)).withColumn("wide", F.size("hashes") >= LONG)
    t = stage(t.withColumn("names", F.array_distinct(_by_length(F.col("words"), shingle_texts))), "templates")
    # Keys of all kinds of windows: (shingle length, hash) or (band, minimum).
    wide = window_values(F.col("hashes"), 1, bands)
    keys = t.select("tid", F.when(F.col("wide"), F.lit(0)).otherwise(F.col("k")).alias("kind"),
                    F.explode(F.array_distinct(F.when(F.col("wide"), wide).otherwise(F.col("hashes")))).alias("key"))
    keys = stage(keys, "template-keys")
    kinds = sorted(r["kind"] for r in keys.select("kind").distinct().collect())  # SHINGLE + 1 at most
    if not kinds:
        return docs.limit(0).select(F.col(id_col).cast("long").alias("doc_id"), F.lit("").alias("template"), F.lit(0).alias("shingles"),
                                    F.lit(0).alias("matched"), F.lit(0.0).alias("containment"))
    docs = placed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows = docs.select(F.col("__loc").alias("loc"), tokens(F.col("text")).alias("words"))
    hashes = {k: shingles(F.col("words"), k) for k in {SHINGLE if kind == 0 else kind for kind in kinds}}
    rows = rows.select("loc", *[h.alias(f"h{k}") for k, h in hashes.items()])
    found = []
    for kind in kinds:
        if not kind:
            found.append(_tagged(F.array_distinct(F.coalesce(window_values(F.col(f"h{SHINGLE}"), HALF, bands), F.array().cast("array<long>"))), 0))
            continue
        own = keys.filter(F.col("kind") == kind).select("key").distinct()
        if own.count() <= INSIDE:  # few keys: texts are searched for them, and only hits become rows
            few = F.array(*[F.lit(r["key"]) for r in own.collect()])
            found.append(_tagged(F.array_intersect(F.col(f"h{kind}"), few), kind))
        else:
            found.append(_tagged(F.array_distinct(F.col(f"h{kind}")), kind))
    # explode_outer: for explode the optimizer adds a filter on the array's
    # size and moves it, with the whole array's work, below the columns above.
    probes = rows.select("loc", F.explode_outer(F.concat(*found)).alias("p")).select("loc", "p.kind", "p.key")
    small = F.broadcast(keys) if keys.count() <= 300_000 else keys
    pairs = stage(probes.join(small, ["kind", "key"]).select("loc", "tid").distinct(), "license-pairs")
    texts = docs.select(F.col("__loc").alias("loc"), "doc_id", "text")
    known = t.select("tid", "template", "k", "names")
    known = F.broadcast(known) if t.count() <= 10_000 else known
    check = texts.join(pairs, "loc").join(known, "tid").withColumn("words", tokens(F.col("text")))
    own = F.lit(None).cast("array<string>")
    for k in sorted({SHINGLE if kind == 0 else kind for kind in kinds}):
        own = F.when(F.col("k") == k, shingle_texts(F.col("words"), k)).otherwise(own)
    # Generated, not projected, for the same reason: the filter stays above.
    matched = F.explode_outer(F.array(F.size(F.array_intersect("names", own)))).alias("matched")
    check = check.select("doc_id", "template", F.size("names").alias("shingles"), matched)
    return check.withColumn("containment", F.col("matched") / F.col("shingles")).filter(F.col("containment") >= least)
