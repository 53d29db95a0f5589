"""Topic words of hand-made documents against a count in plain Python."""

import math
from collections import Counter, defaultdict

from kairos.operators.ml import class_topics, topic_words

DOCS = [  # id, class, text: id 4 comes in two classes, id 5 twice, ids are missing thrice
    (1, "x", "Alpha beta alpha-beta gamma"), (2, "x", "alpha beta delta, delta"), (3, "y", "Gamma delta z beta_1"),
    (4, "x", "omega beta sigma"), (4, "y", "omega beta"), (5, "y", "kappa gamma delta"), (5, "y", "kappa gamma"),
    (None, "x", "theta beta lambda"), (None, "y", "theta"), (None, None, "lambda gamma"), (6, None, "gamma delta gamma"), (7, "y", "")]


def brute(top, min_df, max_df):
    number = {c: i for i, c in enumerate(sorted({c for _, c, _ in DOCS}, key=lambda c: (c is not None, c)))}
    tf, of = Counter(), defaultdict(set)
    for d, c, text in DOCS:
        words = "".join(ch if ch.isalnum() or ch == "_" else " " for ch in text.lower()).split()
        for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            if len(t) > 1:
                tf[number[c], t] += 1
                of[t].add(d)
    n = len({d for d, _, _ in DOCS})
    tf = {k: v for k, v in tf.items() if min_df <= len(of[k[1]]) <= n * max_df}
    f, wc = Counter(), Counter()
    for (c, t), v in tf.items():
        f[t] += v
        wc[c] += v
    a = sum(wc.values()) / len(wc)
    out = {}
    for c in wc:
        rows = sorted((-v * math.log(1 + a / f[t]), t) for (k, t), v in tf.items() if k == c)[:top]
        out |= {(c, r): (t, round(-w, 9)) for r, (w, t) in enumerate(rows, 1)}
    return out


def docs(spark, path):
    spark.createDataFrame(DOCS, "doc_id long, lang string, text string").write.mode("overwrite").parquet(path)
    return class_topics(spark.read.parquet(path))


def test_words_of_repeated_and_missing_ids(spark, tmp_path):
    for top, min_df, max_df in ((10, 2, 0.95), (3, 1, 0.5), (50, 1, 1.0)):
        got = topic_words(docs(spark, f"{tmp_path}/d"), top=top, min_df=min_df, max_df=max_df).collect()
        assert {(r.topic_id, r["rank"]): (r.term, round(r.weight, 9)) for r in got} == brute(top, min_df, max_df)


def test_texts_are_cut_into_terms_once(spark, tmp_path):
    plan = topic_words(docs(spark, f"{tmp_path}/d"))._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "text" not in plan  # what is left reads the counts
