"""Token files: exact round trips and the library's ids."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairos.llm import rans as R
from kairos.llm.bpe import tokenizer_path

SCHEMA = "doc_id long, text string, start string, part string, ids string"


def library_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [e.ids + [2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(rows):
    at, out = 0, []
    for (doc, _), ids in zip(rows, library_ids([t for _, t in rows])):
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=900), st.sampled_from([(1, 3), (4, 16), (16, 64)]), st.data())
def test_round_trip(ids, shape, data):
    counts = np.bincount(np.array(ids + [0], np.int64))
    table = R.Table(R.frequencies(counts))
    payload = R.encode(np.array(ids, np.int64), table, *shape)
    assert R.decode(payload, table).tolist() == ids
    per = shape[0] * shape[1]
    b = data.draw(st.integers(0, max(0, -(-len(ids) // per) - 1)))
    assert R.decode(payload, table, b, b + 1).tolist() == ids[b * per:(b + 1) * per]


def test_size_near_entropy():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 200_000) % 5000
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    bits = -(p * np.log2(p)).sum() * len(ids)
    assert len(R.encode(ids, R.Table(R.frequencies(counts)))) * 8 < bits * 1.05


@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=3000))
@settings(max_examples=30, deadline=None)
def test_frequencies(counts):
    f = R.frequencies(np.array(counts), 14)
    assert (f.sum() == (1 << 14 if any(counts) else 0)) and ((f > 0) == (np.array(counts) > 0)).all()


def test_damage_is_seen():
    ids = np.arange(3000) % 50
    table = R.Table(R.frequencies(np.bincount(ids)))
    payload = bytearray(R.encode(ids, table, 4, 64))
    payload[-3] ^= 1
    with pytest.raises(ValueError):
        R.decode(bytes(payload), table)
    with pytest.raises(ValueError):
        R.decode(bytes(payload[:-8]), table)


def test_small_table(spark, monkeypatch):
    monkeypatch.setattr(R, "FILE_IDS", 200)
    texts = ["", None, " \n\t", "Hello, World! It's 2024.", "ÉTÉ straße ﬁ ñ 漢字 🎉 a\xa0b\x1cc", "x" * 3000, "don't we'll '''s",
             "<|endoftext|> a<|startoftext|>b", "word " * 4000, "ét́ Å", "İI ΑΣ σς"] + ["w%d and more." % i for i in range(60)]
    rows = [(i * 13 % 997, t) for i, t in enumerate(texts)] + [(5000, "same"), (5000, "same")]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows] + [(None, "no id", "", "", "")], SCHEMA).repartition(5)
    got = [tuple(r) for r in R.round_trip(df).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(sorted(rows) + [(None, "no id")])


def test_empty_table(spark):
    df = R.round_trip(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and df.count() == 0


def test_query_matches_library(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_SMALL
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in catalog.q_token_files(spark, SF_SMALL).collect()) == expected(rows)
