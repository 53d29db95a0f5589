"""The url models read the whole url: query, fragment and urls without a scheme."""

import math

from pyspark.sql import functions as F

from kairos.llm import urlfilter as U
from llm.conftest import SF_SMALL
from llm.test_urlfilter import Brute, brute_rule, brute_split, brute_text, evens_of, grams


def check_whole(spark, rows, got):
    parts = {u: brute_split(u) for _, u in rows}
    evens = evens_of(spark, parts.values())
    train = {"allow": [], "block": []}
    for _, u in rows:
        v = brute_rule(*parts[u])[1]
        if v and evens[parts[u]]:
            train[v].append(brute_text(u))
    a, r = Brute(train["allow"]), Brute(train["block"])
    mean = lambda g: sum(math.log(a.p(w, None) / r.p(w, None)) for w in g) / len(g)
    want = sorted((-1 if i is None else i, *parts[u], mean(grams(brute_text(u)))) for i, u in rows)
    have = sorted((-1 if x["page_id"] is None else x["page_id"], x["host"], x["path"], x["score"]) for x in got)
    assert len(have) == len(want)
    for x, y in zip(have, want):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) < 2e-6
    free = [(x["score"], x["verdict"]) for x in got if x["rule"] is None]
    least = min((s for s, v in free if v == "allow"), default=math.inf)
    assert all(s < least for s, v in free if v == "block")


GOOD, BAD = "?ref=good&from=friends", "?buy=pills&now=cheap#spam"


def ruled(n):
    return [(i, f"http://h{i}.example.net/en/{i}{GOOD}") if i % 2 else (i, f"http://h{i}.example.com/de/{i}{BAD}") for i in range(n)]


def test_whole_url_scores(spark):
    rows = ruled(60) + [(100, "http://k.site/es/1" + GOOD), (101, "HTTP://K.site/es/1" + BAD), (102, "k.site/es/1" + GOOD),
                        (103, "K.site/es/1" + BAD), (104, None), (105, ""), (106, "://"), (107, "http://y.site?a=/b"), (None, "http://é.site#ü漢")]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = U.judge(df).collect()
    check_whole(spark, rows, got)
    by = {r["page_id"]: r for r in got}
    assert by[100]["path"] == by[101]["path"] == "/es/1" and by[100]["score"] > by[101]["score"]
    assert (by[100]["verdict"], by[101]["verdict"]) == ("allow", "block")
    assert by[102]["host"] == by[103]["host"] == "" and by[102]["score"] > by[103]["score"]


def test_query_reads_whole_urls(spark):
    from kairos.llm import catalog
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url").collect()]
    assert any("?" in u for _, u in rows) and any("#" in u for _, u in rows)
    check_whole(spark, rows, catalog.q_urls(spark, SF_SMALL).collect())


def test_model_text(spark):
    df = spark.createDataFrame(ruled(40), "page_id long, url string")
    text = df.withColumn("host", U.split_url(F.col("url"))[0]).select(U.model_text(F.col("url"), F.col("host")).alias("t"))
    assert sorted(r["t"] for r in text.collect()) == sorted(brute_text(u) for _, u in ruled(40))
