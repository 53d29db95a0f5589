"""License scan against brute-force containment."""

import re

from kairos.llm import licenses as L

SCHEMA = "doc_id long, text string, template string, loc string, words string"


def brute_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "" if c not in L._DROPPED)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows, notices, least=L.LEAST):
    out = []
    for name, text in notices:
        w = brute_words(text)
        k = min(L.SHINGLE, len(w))
        if not w:
            continue
        have = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
        for d, t in rows:
            v = brute_words(t)
            hit = len(have & {tuple(v[i:i + k]) for i in range(len(v) - k + 1)})
            if hit / len(have) >= least:
                out.append((d, name, len(have), hit, hit / len(have)))
    return sorted(out, key=str)


def test_bands_guarantee():
    j = L.LEAST / (2 - L.LEAST)
    n = L.bands_for()
    assert (1 - j) ** n <= L.MISS < (1 - j) ** (n - 1)


def test_small_table(spark):
    grant = dict(L.NOTICES)["mit-grant"].split()
    edited = grant[:20] + ["NEW"] + grant[21:]  # five shingles of 62 differ
    texts = ["", None, "all rights", "foo bar. ALL RIGHTS\tRESERVED; x", "Licensed under\nthe Apache License, version 2.0. more",
             "licensed under the apache license version 3", " ".join(grant), "pre " * 37 + " ".join(edited) + " post" * 50, " ".join(grant[:30]),
             "a " * 20_000 + "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 2 now", "é ü 漢字 b c d"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "All rights reserved."), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA).repartition(3)
    notices = [*L.NOTICES, ("empty", " "), ("mit", "Released under the MIT License."), ("one", "漢字")]
    got = sorted((tuple(r) for r in L.scan(df, L.template_table(spark, notices)).collect()), key=str)
    assert set(got) == set(brute(rows, notices))
    assert got == brute(rows, notices) and {"mit-grant", "mit", "one"} <= {r[1] for r in got}


def test_windows_find_every_alignment(spark):
    grant = dict(L.NOTICES)["mit-grant"]
    rows = [(i, "filler%d " % i * i + grant + " end" * 7) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in L.scan(df, L.template_table(spark)).collect()} == set(range(40))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    assert L.scan(df.limit(0), L.template_table(spark)).count() == 0
    assert L.scan(df, L.template_table(spark).limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_SMALL
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in catalog.q_licenses(spark, SF_SMALL).collect()), key=str)
    assert got == brute(rows, L.NOTICES) and got
