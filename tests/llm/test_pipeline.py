"""The corpus pipeline: every stage against brute force on its own input."""

import hashlib

import corpus_pipeline as P
from kairos.llm.common import stage
from llm.conftest import SF_SMALL
from llm.test_exactdedup import low
from llm.test_mixing import brute as brute_mix
from llm.test_simhash import brute_components, brute_fp


def keys(rows):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["source"] or "") for r in rows)


def walk(spark, docs, sf):
    cols, out = docs.columns, [docs]
    for _, fn in P.STAGES[:-1]:
        docs = stage(fn(spark, docs, sf), "t")
        assert docs.columns == cols
        out.append(docs)
    return [d.collect() for d in out], P.STAGES[-1][1](spark, docs, sf).collect()


def check(steps, last):
    docs, spoken, exact, near, mixed = steps
    assert keys(spoken) == keys(r for r in docs if any(c.isalpha() for c in r["text"] or ""))
    best = {}
    for r in spoken:
        k = low(r["text"])
        if k not in best or (r["doc_id"] is not None and (best[k]["doc_id"] is None or r["doc_id"] > best[k]["doc_id"])):
            best[k] = r
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in exact) == sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in best.values())
    assert sorted(low(r["text"]) for r in exact) == sorted(best)
    ids = [r["doc_id"] for r in exact]
    comp = brute_components(ids, [brute_fp(r["text"]) for r in exact])
    assert sorted(str(r["doc_id"]) for r in near) == sorted({str(c) for c in comp})
    taken = {r[0]: (r[1], r[4]) for r in brute_mix([(r["doc_id"], r["text"], r["source"]) for r in near])}
    count = {}
    for r in mixed:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert {d: n * count.get(d, 0) for d, (n, _) in taken.items()} == {d: t for d, (_, t) in taken.items()}
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert len(last) == len(mixed)
    assert all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() for r in last)


def test_whole_table(spark):
    steps, last = walk(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"), SF_SMALL)
    check(steps, last)
    assert 0 < len(steps[3]) < len(steps[2]) < len(steps[1])


def test_odd_rows(spark):
    words = " ".join("word%d" % (i * 7 % 90) for i in range(80))
    rows = [(1, words, "en", "a", 1, "x"), (2, words.upper(), "en", "a", 1, "x"), (3, words + " more", "en", "b", 1, "x"), (4, "", "en", "a", 0, "x"), (5, None, None, None, None, "x"),
            (6, "12 !", "en", "a", 4, "x"), (None, "no id here", "en", None, 10, "x"), (7, "lonely", None, None, 6, "x"), (8, "long " * 30_000, "en", "b", 5, "x")]
    df = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key string"), "odd")
    check(*walk(spark, df, SF_SMALL))


def test_clashing_columns(spark):
    """Columns named like the stages' own helpers come out unchanged."""
    names = ["__loc", "__loc_", "__p", "__size", "__source_size", "__target", "__copies", "__copy", "__s", "loc", "row", "keep_id", "digest", "key", "fp", "lang_pred", "col"]
    rows = [(i, "some words of text number %d that stand alone" % i, "en", "s%d" % (i % 3), i, *[f"{n}{i}" for n in names]) for i in range(12)]
    rows += [(100, rows[3][1].upper(), "en", "s0", 5, *[n for n in names])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    whole = {tuple(r) for r in rows}
    for name, fn in P.STAGES[:-1]:
        got = fn(spark, df, SF_SMALL)
        assert got.columns == df.columns, name
        out = got.collect()
        assert out and {tuple(r) for r in out} <= whole, name
    assert P.STAGES[-1][1](spark, df, SF_SMALL).count() == len(rows)


def test_empty_table(spark):
    df = stage(spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0), "none")
    steps, last = walk(spark, df, SF_SMALL)
    assert not last and not any(steps)
