"""Streamed exact dedup against brute force, with colliding digests too."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kairos.llm import exactdedup as E

SCHEMA = "doc_id long, text string, digest string, loc string, n string"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda d: -1 if d is None else d)
        out += [(d, ids[-1], len(ids), i == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=str)


TEXTS = ["Same", "sAME", "same ", "", None, "É", "é", "x" * 100_000, "X" * 100_000, "other", "Other", "OTHER", "ſ", "s"]
ROWS = [(i * 17 % 53, t) for i, t in enumerate(TEXTS)] + [(7, "same"), (7, "same"), (None, "other"), (None, "lone"), (None, "lone")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(d, t, "a", "b", "c") for d, t in ROWS], SCHEMA).repartition(4)


def test_small_table(docs):
    got = sorted((tuple(r) for r in E.exact_duplicates(docs).collect()), key=str)
    assert got == brute(ROWS)


def test_colliding_digests_are_told_apart(docs):
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    got = sorted((tuple(r)[:4] for r in E.exact_duplicates(docs, digest=weak).collect()), key=str)
    assert got == sorted((r[:4] for r in brute(ROWS)), key=str)


def test_keep_first(docs):
    kept = E.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(low(r["text"]) for r in kept.collect()) == sorted({low(t) for _, t in ROWS})


def test_state_does_not_depend_on_batches(spark, docs):
    from kairos.llm.common import stage
    rows = stage(E.located(docs, "doc_id", "text", E.sha256).repartition(6), "t")
    one, many = (sorted(map(tuple, E.stream_state(rows, n).collect())) for n in (100, 1))
    assert one == many and len(one) == len({low(t) for _, t in ROWS})


def test_empty_table(spark):
    df = E.exact_duplicates(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0
