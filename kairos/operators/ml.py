"""Models on tables (N1-N14, D13, D17, D31, E35), re-aimed on Spark ML.

Fitting runs on executors (EM / tree aggregation); inputs are one row per
date for regimes (bounded by the calendar) and the full feature table for
the action classifier. Nothing is collected to pandas.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div
from ..functions.text import topic_label
from ..session import layer_table, materialize
from .boost import Model, Params, train
from .density import clusters, project
from .hmm import fit_paths


def regime_features(bench: DataFrame, t="dt") -> DataFrame:
    """|return|, 5-row mean return (full frames), vol pct change,
    log1p volume; rows with a missing feature dropped."""
    w = Window.partitionBy("ticker").orderBy(t)
    f5 = w.rowsBetween(-4, 0)
    df = bench.withColumns({
        "abs_return": F.abs("daily_return"),
        "return_5d": F.when(F.count("daily_return").over(f5) == 5, F.avg("daily_return").over(f5)),
        "vol_change": div(F.col("realized_vol_20d") - F.lag("realized_vol_20d").over(w), F.lag("realized_vol_20d").over(w)),
        "log_volume": F.log1p(F.col("volume").cast("double"))})
    return df.dropna(subset=["daily_return", "realized_vol_20d", "return_5d", "vol_change", "log_volume"])


def detect_regimes(feats: DataFrame, k=3, cols=("daily_return", "realized_vol_20d", "return_5d"), rounds=200, tol=1e-2, key="ticker",
                   t="dt") -> DataFrame:
    """A Gaussian hidden Markov model with ``k`` states for each series
    (Baum-Welch, then the Viterbi path); a series' states are labelled by rank
    of their mean return (lowest Bear, middle Neutral, highest Bull; other
    ranks State_i)."""
    _, paths = fit_paths(feats, key, t, cols, k, rounds, tol)
    pred = materialize(feats.join(paths.select(F.col("key").alias(key), F.col("t").alias(t), F.col("state").alias("regime_id")), [key, t]))
    rk = regime_stats(pred, (key,)).withColumn("__rk", F.row_number().over(Window.partitionBy(key).orderBy("mean_return", "regime_id")))
    last = F.max("__rk").over(Window.partitionBy(key))
    lab = F.when(F.col("__rk") == 1, "Bear").when(F.col("__rk") == last, "Bull").when(F.col("__rk") == 2, "Neutral") \
        .otherwise(F.concat(F.lit("State_"), F.col("__rk").cast("string")))
    return pred.join(rk.select(key, "regime_id", lab.alias("regime_label")), [key, "regime_id"])


def regime_stats(pred: DataFrame, by=()) -> DataFrame:
    """Days, share, mean/std return, mean vol, mean 5-day return per state
    (of each series if ``by`` names its key)."""
    g = pred.groupBy(*by, "regime_id").agg(
        F.count(F.lit(1)).alias("days"), F.avg("daily_return").alias("mean_return"),
        F.stddev_samp("daily_return").alias("std_return"), F.avg("realized_vol_20d").alias("mean_vol"),
        F.avg("return_5d").alias("mean_5d_return"))
    return g.withColumn("pct", F.col("days") * 100.0 / F.sum("days").over(Window.partitionBy(*by)))


# Per-regime agent parameters (urgency, buy bias, vol threshold).
REGIME_CONFIG = [("Bull", 1.0, 0.55, 0.15), ("Neutral", 1.3, 0.40, 0.22), ("Bear", 2.0, 0.25, 0.30)]


def with_regime_config(df: DataFrame) -> DataFrame:
    """Urgency and buy bias per regime label (broadcast, 3 rows)."""
    cfg = df.sparkSession.createDataFrame(REGIME_CONFIG, "regime_label string, agent_urgency double, "
                                                         "buy_bias double, vol_threshold double")
    return df.join(F.broadcast(cfg), "regime_label", "left")


def regime_rule_label(stats: DataFrame) -> DataFrame:
    """bull/bear by mean return sign, quiet/volatile by the median of
    the states' mean vol."""
    med = F.percentile("mean_vol", 0.5).over(Window.partitionBy())
    bull = F.col("mean_return") > 0
    quiet = F.col("mean_vol") < med
    lab = F.when(bull & quiet, "bull_quiet").when(bull, "bull_volatile").when(quiet, "bear_quiet") \
        .otherwise("bear_volatile")
    return stats.withColumn("rule_label", lab)


def regime_transitions(df: DataFrame, t="dt", label="regime_label") -> DataFrame:
    """D17 + E35: counts of consecutive label pairs and row shares."""
    w = Window.orderBy(t)  # one row per date: bounded by the calendar
    x = df.select(t, label).withColumn("prev_label", F.lag(label).over(w)).filter(F.col("prev_label").isNotNull())
    g = x.groupBy("prev_label", F.col(label).alias("next_label")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("prev_label")))


def label_actions(df: DataFrame, premium_factor=1.0) -> DataFrame:
    """Profits of the four actions over 5 days and the best one.
    premium = vol * sqrt(5/252) * factor; rows need a forward return and
    a positive volatility."""
    d = df.filter(F.col("fwd_return_5d").isNotNull() & F.col("realized_vol_20d").isNotNull()
                  & (F.col("realized_vol_20d") > 0))
    d = d.withColumn("premium", F.col("realized_vol_20d") * F.lit(math.sqrt(5.0 / 252.0)) * F.lit(premium_factor))
    r = F.col("fwd_return_5d")
    d = d.withColumns({"buy_profit": r, "short_profit": -r,
                       "call_profit": F.greatest(F.lit(0.0), r) - F.col("premium"),
                       "put_profit": F.greatest(F.lit(0.0), -r) - F.col("premium")})
    b, s, c, p = (F.col(x) for x in ("buy_profit", "short_profit", "call_profit", "put_profit"))
    act = (F.when((b >= s) & (b >= c) & (b >= p), "BUY").when((s >= b) & (s >= c) & (s >= p), "SHORT")
           .when(c >= p, "CALL").otherwise("PUT"))
    return d.withColumn("optimal_action", act)


def time_split(df: DataFrame, t="dt", test=0.2) -> DataFrame:
    """cutoff = the distinct date at index int(n * (1 - test));
    ``is_test`` for dates on or after it. Windows over distinct dates only."""
    d = df.select(t).distinct()
    d = d.withColumns({"__i": F.row_number().over(Window.orderBy(t)) - 1,
                       "__n": F.count(F.lit(1)).over(Window.partitionBy())})
    cut = d.filter(F.col("__i") == F.floor(F.col("__n") * (1.0 - test)).cast("int")).select(F.col(t).alias("cutoff"))
    return df.withColumn("__k", F.lit(1)).join(F.broadcast(cut.withColumn("__k", F.lit(1))), "__k") \
        .drop("__k").withColumn("is_test", F.col(t) >= F.col("cutoff"))


ACTIONS = ["BUY", "CALL", "PUT", "SHORT"]


def train_actions(df: DataFrame, features, params: Params | None = None, key=("ticker", "dt")) -> Model:
    """Boosted trees for the four actions on the time split; the rows of
    the test dates stop the training early. Classes weigh alike."""
    return train(df.dropna(subset=list(features)), features, "optimal_action", ACTIONS, "is_test", key, params)


def score_actions(model: Model, df: DataFrame, version="gbdt-1") -> DataFrame:
    """Class probabilities, argmax action (first of equal ones) and confidence."""
    out = model.predict(df, "__p")
    out = out.withColumns({f"prob_{a.lower()}": F.col("__p")[i] for i, a in enumerate(ACTIONS)}).withColumn("confidence", F.array_max("__p"))
    names = F.array(*[F.lit(a) for a in ACTIONS])
    out = out.withColumn("ml_action", F.element_at(names, F.array_position("__p", F.col("confidence")).cast("int")))
    return out.withColumns({"model_version": F.lit(version), "scored_at": F.current_timestamp()}).drop("__p")


def confusion(pred: DataFrame, label="optimal_action", predicted="ml_action") -> DataFrame:
    """Rows of each (actual, predicted) pair of actions, empty ones too."""
    spark = pred.sparkSession
    cells = spark.createDataFrame([(a, b) for a in ACTIONS for b in ACTIONS], "actual string, predicted string")
    n = pred.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["actual", "predicted"], "left").fillna(0, ["n"])


def importances(spark, model: Model) -> DataFrame:
    """Total gain and number of splits of each feature, all features."""
    rows = spark.createDataFrame([(s[3], s[5]) for s in model.splits() if s[3] is not None], "feature string, gain double")
    all_ = spark.createDataFrame([(f,) for f in model.features], "feature string")
    return all_.join(rows.groupBy("feature").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits")), "feature", "left") \
        .fillna(0.0, ["gain"]).fillna(0, ["splits"])


def action_coverage(pred: DataFrame, total: DataFrame, predicted="ml_action", key=("ticker", "dt")) -> DataFrame:
    """Predicted rows and their share by action, and the share of all
    rows that were scored."""
    n = total.select(*key).distinct().count()
    g = pred.groupBy(F.col(predicted).alias("action")).agg(F.count(F.lit(1)).alias("predicted_rows"), F.avg("confidence").alias("mean_confidence"))
    return g.withColumns({"share": F.col("predicted_rows") / F.sum("predicted_rows").over(Window.partitionBy()),
                          "coverage": F.sum("predicted_rows").over(Window.partitionBy()) / F.lit(float(max(1, n)))})


def numeric_features(df: DataFrame, exclude) -> list[str]:
    """The numeric columns by schema type, less the excluded ones, sorted."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    gone = {c.lower() for c in exclude}
    return sorted(f.name for f in df.schema.fields if f.dataType.simpleString().split("(")[0] in kinds and f.name.lower() not in gone)


def evaluate(pred: DataFrame, label="optimal_action", predicted="ml_action") -> DataFrame:
    """Per-class precision/recall/F1 with support, plus accuracy and
    macro / weighted F1 as extra rows (class = '__macro', '__weighted',
    '__accuracy'). Confusion counts come from one groupBy."""
    cm = pred.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.filter(F.col("actual") == F.col("pred")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = sup.join(prd, "cls", "full").join(tp, "cls", "left").fillna(0, ["support", "predicted", "tp"])
    per = per.withColumns({"precision": F.coalesce(div(F.col("tp").cast("double"), "predicted"), F.lit(0.0)),
                           "recall": F.coalesce(div(F.col("tp").cast("double"), "support"), F.lit(0.0))})
    per = per.withColumn("f1", F.coalesce(div(2 * F.col("precision") * F.col("recall"),
                                              F.col("precision") + F.col("recall")), F.lit(0.0)))
    allw = Window.partitionBy()
    per = per.withColumns({"__n": F.sum("support").over(allw), "__acc": F.sum("tp").over(allw),
                           "__mf1": F.avg("f1").over(allw),
                           "__wf1": F.sum(F.col("f1") * F.col("support")).over(allw)})
    summary = per.select(F.lit("__summary").alias("cls"), (F.col("__acc") / F.col("__n")).alias("accuracy"),
                         F.col("__mf1").alias("macro_f1"), (F.col("__wf1") / F.col("__n")).alias("weighted_f1")).limit(1)
    return per.drop("__n", "__acc", "__mf1", "__wf1").unionByName(summary, allowMissingColumns=True)


def cluster_embeddings(df: DataFrame, eps=0.25, least=5, dims=3, seed=42, vec="embedding", id_="vec_id", width=64) -> DataFrame:
    """Random projection to ``dims``, then density clusters; topic_id is
    the cluster's smallest core id, -1 for outliers."""
    points = project(df.select(F.col(id_).alias("id"), vec), vec, dims, seed, width).select("id", "v")
    return clusters(points, eps, least, dims).select(F.col("id").alias(id_), F.col("cluster").alias("topic_id"), "core")


def class_topics(docs: DataFrame, cls="lang", out="topic_id") -> DataFrame:
    """The number of each document's class, in order of the class names
    (null first). Only the distinct classes are numbered, and joined back: as
    a written table their size is known, so no text is dealt by its class."""
    names = docs.select(F.col(cls).alias("__c")).distinct()
    names = layer_table(names.withColumn(out, F.row_number().over(Window.orderBy("__c")) - 1), "classes")
    return docs.join(names, F.col(cls).eqNullSafe(F.col("__c")), "left").drop("__c")


def topic_words(docs: DataFrame, text="text", cls="topic_id", top=10, min_df=2, max_df=0.95) -> DataFrame:
    """Class-based TF-IDF of 1-2-grams (stop words removed) per class:
    w = tf(t, c) * log(1 + A / f(t)), A = mean words per class, f(t) = total
    count of t; terms in < ``min_df`` documents or > ``max_df`` of them
    dropped; top ``top`` terms per class. The texts are cut into terms once and
    counted by (term, class) on the map side; what follows reads the counts."""
    from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
    ids = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__c"))
    ndocs = ids.agg(F.count(F.lit(1)).alias("__N"))
    again = layer_table(ids.filter((F.col("__c") > 1) & F.col("__id").isNotNull()).select("__id"), "repeated-ids")
    # Rows of a document that has no other row count by themselves; only those
    # of repeated or missing ids keep the id beside the term.
    x = docs.select("doc_id", cls, text).join(again, F.col("doc_id") == F.col("__id"), "left")
    x = x.withColumn("__many", F.col("__id").isNotNull() | F.col("doc_id").isNull())
    x = x.select(F.when(F.col("__many"), F.col("doc_id")).alias("__did"), "__many", cls, text)
    tok = RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True)
    x = tok.transform(x)
    x = StopWordsRemover(inputCol="__w", outputCol="__u").transform(x)
    x = NGram(n=2, inputCol="__u", outputCol="__b").transform(x)
    # Sorted, equal terms of a row lie together: the first of them counts the row.
    x = x.select("__did", "__many", cls, F.sort_array(F.concat("__u", "__b")).alias("__t"))
    x = x.select("__did", "__many", cls, F.explode(F.arrays_zip(
        F.col("__t").alias("term"), F.concat(F.array(F.lit("")), F.col("__t")).alias("before"))).alias("__z"))
    x = x.select("__did", "__many", cls, F.col("__z.term").alias("term"), (F.col("__z.term") != F.col("__z.before")).alias("new"))
    part = x.filter(F.length("term") > 1).groupBy("term", cls, "__many", "__did").agg(
        F.count(F.lit(1)).alias("tf"), F.sum(F.col("new").cast("long")).alias("rows"))
    # The counts are dealt by term once; a term has a row for each class and repeated id.
    of_id, of_term = Window.partitionBy("term", "__many", "__did").orderBy(cls), Window.partitionBy("term")
    part = part.repartition("term").withColumn("__r", F.row_number().over(of_id))
    documents = F.when(~F.col("__many"), F.col("rows")).otherwise((F.col("__r") == 1).cast("long"))
    part = part.withColumns({"f": F.sum("tf").over(of_term), "__df": F.sum(documents).over(of_term)})
    part = part.filter(F.col("__df") >= min_df).join(F.broadcast(ndocs), F.col("__df") <= F.col("__N") * max_df)
    tc = layer_table(part.groupBy("term", cls, "f").agg(F.sum("tf").alias("tf")), "class-terms")
    words_per_class = tc.groupBy(cls).agg(F.sum("tf").alias("__wc"))
    a = F.avg("__wc").over(Window.partitionBy())
    avgw = words_per_class.withColumn("A", a).select(cls, "A")
    s = tc.join(F.broadcast(avgw), cls)
    s = s.withColumn("weight", F.col("tf") * F.log(F.lit(1.0) + F.col("A") / F.col("f")))
    r = F.row_number().over(Window.partitionBy(cls).orderBy(F.col("weight").desc(), F.col("term")))
    return s.withColumn("rank", r).filter(F.col("rank") <= top).select(cls, "term", "weight", "rank")


def assign_topics(words: DataFrame, cls="topic_id") -> DataFrame:
    """N14 + L8: keywords per topic (ordered) and the rule-based label."""
    kw = words.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("__kw"))
    kw = kw.withColumn("keywords", F.transform("__kw", lambda s: s["term"])).drop("__kw")
    return kw.withColumn("topic_label", topic_label(F.col(cls), F.col("keywords")))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per (a, b) with margins (cube); nulls mark totals."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"))
