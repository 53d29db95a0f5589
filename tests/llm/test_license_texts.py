"""License bodies and headers are templates; edited notices are found at the bound."""

from pyspark.sql import functions as F

from kairos.llm import licenses as L
from llm.test_licenses import brute

NOTICES = dict(L.NOTICES)
SCHEMA = "doc_id long, text string"


def test_bodies_headers_and_short_notices(spark):
    names = ("apache-2.0-text", "gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "lgpl-3.0-text", "mpl-2.0-text", "cc0-1.0-text", "bsd-2-clause-grant",
             "bsd-3-clause-grant", "bsd-disclaimer", "isc-text", "mit-warranty", "apache-2.0-header", "gpl-3.0-header", "cc-by-4.0")
    assert len(NOTICES) == len(L.NOTICES)
    rows = [(i, f"intro {i} " * i + NOTICES[n].replace(" ", "\n", 3) + " the end") for i, n in enumerate(names)]
    rows += [(100, "Licensed under the MIT license"), (101, "x Distributed under the BSD License y"), (102, "licensed under a license")]
    got = sorted((tuple(r) for r in L.scan(spark.createDataFrame(rows, SCHEMA), L.template_table(spark)).collect()), key=str)
    assert got == brute(rows, L.NOTICES)
    assert {(i, n) for i, n in enumerate(names)} | {(100, "mit-licensed"), (101, "bsd-distributed")} <= {r[:2] for r in got}
    assert 102 not in {r[0] for r in got}


def test_planted_edits_at_the_bound_are_found(spark):
    name, least = "mit-grant", L.LEAST
    words, rows = NOTICES[name].split(), []
    for at in range(0, len(words) - 8, 3):
        for lead in range(0, 16, 3):
            near, far = words[:at] + ["x"] * 8 + words[at + 8:], list(words)
            far[at % 20 + 5] = far[at % 20 + 30] = "y"
            rows += [(len(rows) + k, "pre " * lead + " ".join(t) + " post" * (lead % 5)) for k, t in enumerate((near, far))]
    templates = [(name, NOTICES[name])]
    want = brute(rows, templates)
    got = sorted((tuple(r) for r in L.scan(spark.createDataFrame(rows, SCHEMA), L.template_table(spark, templates)).collect()), key=str)
    assert got == want and len(want) > 150 and min(r[4] for r in want) < least + 0.01


def test_text_windows_overlap(spark):
    n = 45
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.xxhash64(i)).alias("h"))
    starts = [*range(0, n - L.WINDOW + 1, L.WINDOW // 2), n - L.WINDOW]
    want = F.flatten(F.array(*[L.band_values(F.slice("h", s + 1, L.WINDOW), 3) for s in starts]))
    r = df.select(L.window_values(F.col("h"), L.HALF, 3).alias("got"), want.alias("want")).first()
    assert set(r["want"]) <= set(r["got"]) and len(r["got"]) <= len(r["want"]) + 3
    short = spark.range(1).select(F.array(F.lit(1).cast("long")).alias("h"))
    assert short.select(L.window_values(F.col("h"), L.HALF, 3).alias("got")).first()["got"] is None
