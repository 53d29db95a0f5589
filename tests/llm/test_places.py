"""Rows found twice stay the same rows when the splits of the input move."""

import tempfile

import pytest

from kairos.llm import exactdedup as E
from kairos.llm import licenses as L
from kairos.llm import simhash as S
from llm.test_exactdedup import brute

TEXTS = ["All rights reserved. %d" % (i // 2) for i in range(40)] + ["plain words of row %d and nothing else %d" % (i, i * i) for i in range(40)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)]
KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture()
def docs(spark):
    path = tempfile.mkdtemp(prefix="kairos-places-") + "/t"
    spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, lang string").repartition(16).write.parquet(path)
    old = {k: spark.conf.get(k) for k in KEYS}
    yield spark.read.parquet(path)
    for k, v in old.items():
        spark.conf.set(k, v)


def move(spark):
    """What a changed number of cores does: other splits of the same files."""
    spark.conf.set(KEYS[0], "600")
    spark.conf.set(KEYS[1], "1")


def test_exact_dedup(spark, docs, monkeypatch):
    real = E.stream_state

    def moved(rows, *a):
        out = real(rows, *a)
        move(spark)
        return out

    monkeypatch.setattr(E, "stream_state", moved)
    assert sorted((tuple(r) for r in E.exact_duplicates(docs).collect()), key=str) == brute(ROWS)


def test_keep_first(spark, docs):
    kept = E.keep_first(docs)
    move(spark)
    assert sorted(r["text"] for r in kept.collect()) == sorted(set(TEXTS))


def test_keep_one(spark, docs):
    kept = S.keep_one(docs)
    want = sorted({r["component_id"] for r in S.near_duplicates(docs).collect()})
    move(spark)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_license_scan(spark, docs):
    got = L.scan(docs, L.template_table(spark))
    move(spark)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40))
