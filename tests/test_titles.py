"""The batched scorer against plain numpy."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID
from kairos.operators import titles as T
from kairos.plans import catalog_titles as C
from kairos.plans import fixtures as FX


def plain_features(text):
    x = np.zeros(T.BUCKETS + 1)
    words = re.findall(r"\w+", (text or "").lower())
    for w in words:
        x[zlib.crc32(w.encode()) % T.BUCKETS] += 1
    if words:
        x /= np.linalg.norm(x)
        x[-1] = 1
    return x


def plain_fit(rows, ridge=1.0):
    x = np.array([plain_features(t) for t, _ in rows])
    y = np.array([m for _, m in rows], dtype=float)
    return np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)


def plain_label(s):
    return "positive" if s > 0.1 else "negative" if s < -0.1 else "neutral"


def test_scores_of_the_query(spark):
    m = C.marked_titles(spark, SF_MID)
    w = plain_fit([(r["title"], r["mark"]) for r in m.filter(~F.col("held_out")).collect()])
    want = {r["url"]: float(np.clip(plain_features(r["title"]) @ w, -1, 1)) for r in FX.articles(spark, SF_MID).select("url", "title").collect()}
    got = C.q_title_scores(spark, SF_MID).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r["sentiment_score"] - want[r["url"]]) < 1e-9
        assert r["sentiment_label"] == plain_label(want[r["url"]]) or abs(abs(want[r["url"]]) - 0.1) < 1e-9


def test_held_out_marks_are_told_apart(spark):
    rows = [r for r in C.q_title_report(spark, SF_MID).collect() if r["held_out"]]
    mean = {k: sum(r["articles"] * r["mean_score"] for r in rows if r["mark"] == k) / sum(r["articles"] for r in rows if r["mark"] == k) for k in (1, -1)}
    assert mean[1] > mean[-1] + 0.2
    right = sum(r["articles"] for r in rows if (r["sentiment_label"], r["mark"]) in (("positive", 1), ("negative", -1)))
    wrong = sum(r["articles"] for r in rows if (r["sentiment_label"], r["mark"]) in (("positive", -1), ("negative", 1)))
    assert right > 2 * wrong


def test_small_cases(spark):
    long = "good " * 200000
    data = [("good good day", 1), ("bad day", -1), (None, 1), ("", -1), ("  ..", 1), ("good", None), ("day", 3), ("Bad, bad!", -1), (long, 1), ("good good day", 1)]
    df = spark.createDataFrame([(t, m, "x") for t, m in data], "t string, mark int, `__scored` string").repartition(4)
    model = T.fit_titles(df, "t", "mark")
    w = plain_fit([(t, m) for t, m in data if t and m in (1, -1)])
    assert np.allclose(model.weights, w, atol=1e-9)
    got = T.with_scores(df.drop("__scored"), "t", model).collect()
    assert len(got) == len(data)
    for r in got:
        s = float(np.clip(plain_features(r["t"]) @ w, -1, 1))
        assert abs(r["sentiment_score"] - s) < 1e-9 and r["sentiment_label"] == plain_label(s)
        assert r["t"] not in (None, "", "  ..") or (r["sentiment_score"], r["sentiment_label"]) == (0.0, "neutral")


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("good", "x", 1)], "t string, `__scored` string, `a.b` int")
    row = T.with_scores(df, "t", T.TitleModel(np.ones(T.BUCKETS + 1))).collect()[0]
    assert row["__scored"] == "x" and row["a.b"] == 1 and row["sentiment_score"] == 1.0


def test_no_learning_rows(spark):
    df = spark.createDataFrame([], "t string, mark int")
    model = T.fit_titles(df, "t", "mark")
    assert not model.weights.any() and T.with_scores(df, "t", model).count() == 0


def test_any_scorer_is_loaded_once_a_task_at_most(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os
        with open(f"{log}-{os.getpid()}", "a") as f:
            f.write("x")
        return lambda texts: [len(t) / 10 - 0.5 for t in texts]
    df = spark.range(0, 5000, numPartitions=16).select(F.expr("repeat('a', cast(id % 11 as int))").alias("t"))
    got = df.select("t", T.score_text(df, "t", load).alias("s")).select("t", "s.*").collect()
    assert all(abs(r["score"] - (len(r["t"]) / 10 - 0.5)) < 1e-12 and r["label"] == plain_label(r["score"]) for r in got) and len(got) == 5000
    assert all(p.read_text() == "x" for p in tmp_path.iterdir())
