"""Registered queries of the batched title scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import news as W
from ..operators import titles as T
from ..registry import register
from ..sources import load
from . import fixtures as FX

HELD_OUT = 5  # rows whose crc32 of the id divides by it judge the model


def marked_titles(spark, sf):
    """Articles of labelled documents: mark +1 or -1, and whether held out."""
    lab = load(spark, sf, "labels").filter("quality IN (0, 1)").select("doc_id", (F.col("quality") * 2 - 1).alias("mark"))
    return FX.articles(spark, sf).select("doc_id", "title").join(lab, "doc_id").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0)


def title_model(spark, sf) -> T.TitleModel:
    key = ("titles", spark.sparkContext.applicationId, sf, FX.stamp(spark, sf, ("documents", "labels")))
    if key not in FX._TABLES:
        FX._TABLES[key] = T.fit_titles(marked_titles(spark, sf).filter(~F.col("held_out")), "title", "mark")
    return FX._TABLES[key]


@register("title_scores", ops=("N1", "U4"))
def q_title_scores(spark, sf):
    """Score and label of every article's title by the fitted scorer."""
    a = FX.articles(spark, sf).select("url", "title")
    return W.score_text(a, "title", title_model(spark, sf)).drop("title")


@register("title_report", ops=("N1", "D28"))
def q_title_report(spark, sf):
    """Labels given to marked articles, learned from or held out."""
    s = W.score_text(marked_titles(spark, sf), "title", title_model(spark, sf))
    return s.groupBy("held_out", "mark", "sentiment_label").agg(F.count(F.lit(1)).alias("articles"), F.avg("sentiment_score").alias("mean_score"))


@register("model_sentiment", ops=("D4", "E30", "N1"))
def q_model_sentiment(spark, sf):
    """Daily sentiment by instrument from the fitted scorer."""
    a = W.score_text(FX.articles(spark, sf), "title", title_model(spark, sf))
    return W.sentiment_rolling(W.daily_sentiment(W.explode_matches(a, "title", FX.KEYWORDS)))
