"""News, sentiment and post aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexicon_sentiment, match_keywords
from .titles import with_scores


def explode_matches(df: DataFrame, text: str, keywords: dict, out="ticker") -> DataFrame:
    """L1 + L3: one row per (article, matched instrument)."""
    return df.withColumn("matched", match_keywords(text, keywords)) \
        .select("*", F.explode("matched").alias(out)).drop("matched")


def daily_news(exploded: DataFrame, t="published_date") -> DataFrame:
    """D3: per (instrument, day): count, tone mean/std(null->0)/min/max,
    distinct sources and the scenario of the smallest url (deterministic
    stand-in for ``first``). The per-group title list of the source is not
    built: it is an unbounded collection per group."""
    g = exploded.groupBy("ticker", t).agg(
        F.count(F.lit(1)).alias("news_count"), F.avg("tone").alias("avg_news_tone"),
        F.stddev_samp("tone").alias("std_news_tone"), F.min("tone").alias("min_news_tone"),
        F.max("tone").alias("max_news_tone"), F.count_distinct("source").alias("unique_sources"),
        F.min_by("scenario", "url").alias("news_scenario"))
    return g.withColumn("std_news_tone", F.coalesce("std_news_tone", F.lit(0.0)))


def news_rolling(df: DataFrame, t="published_date") -> DataFrame:
    """3/7-row mean counts, 3-row mean tone, tone delta vs 3 rows back,
    count z-score over 7 rows (0 when std is 0 or null). Rows, not days."""
    from ..operators.windows import frame, w
    f3, f7 = frame(3, "ticker", t), frame(7, "ticker", t)
    s7 = F.stddev_samp("news_count").over(f7)
    return df.withColumns({
        "news_count_3d_avg": F.avg("news_count").over(f3),
        "news_count_7d_avg": F.avg("news_count").over(f7),
        "news_tone_3d_avg": F.avg("avg_news_tone").over(f3),
        "news_tone_delta_3d": F.col("avg_news_tone") - F.lag("avg_news_tone", 3).over(w("ticker", t)),
        "news_count_zscore": F.when(s7 > 0, (F.col("news_count") - F.avg("news_count").over(f7)) / s7)
        .otherwise(F.lit(0.0))})


def score_text(df: DataFrame, text: str, scorer=None, neg=None, pos=None) -> DataFrame:
    """Score each text. The default scorer is the lexicon (L6), a JVM
    expression; ``scorer`` is the ``load`` of a batched one (``titles``)."""
    if scorer is not None:
        return with_scores(df, text, scorer)
    s = lexicon_sentiment(text, neg, pos)
    return df.withColumns({"sentiment_score": s["score"], "sentiment_label": s["label"],
                           "sentiment_confidence": F.abs(s["score"])})


def daily_sentiment(scored: DataFrame, t="published_date") -> DataFrame:
    """Per (instrument, day) sentiment statistics and label counts."""
    g = scored.groupBy("ticker", t).agg(
        F.count(F.lit(1)).alias("news_count"), F.avg("sentiment_score").alias("sentiment_mean"),
        F.stddev_samp("sentiment_score").alias("sentiment_std"), F.min("sentiment_score").alias("sentiment_min"),
        F.max("sentiment_score").alias("sentiment_max"), F.avg("sentiment_confidence").alias("avg_confidence"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive_count"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative_count"),
        F.count_if(F.col("sentiment_label") == "neutral").alias("neutral_count"))
    return g.withColumns({"positive_ratio": F.col("positive_count") / F.col("news_count"),
                          "sentiment_dispersion": F.coalesce("sentiment_std", F.lit(0.0))})


def sentiment_rolling(df: DataFrame, t="published_date") -> DataFrame:
    """Delta vs 3 rows back and 3-row mean of the daily mean."""
    from ..operators.windows import frame, w
    return df.withColumns({
        "sentiment_delta_3d": F.col("sentiment_mean") - F.lag("sentiment_mean", 3).over(w("ticker", t)),
        "sentiment_momentum_3d": F.avg("sentiment_mean").over(frame(3, "ticker", t))})


def daily_activity(posts: DataFrame, t="created_date") -> DataFrame:
    """Posts, summed score and comments per day."""
    return posts.groupBy(t).agg(F.count(F.lit(1)).alias("posts"), F.sum("score").alias("total_score"),
                                F.sum("num_comments").alias("total_comments"))


# Regime multipliers (urgency, sell boost, buy boost).
REACTION_MULTIPLIERS = {"Bear": (1.3, 1.5, 0.6), "Bull": (0.9, 0.7, 1.4), "Neutral": (1.0, 1.0, 1.0)}


def agent_reaction(items: DataFrame, ticker_sent: DataFrame, regime: DataFrame) -> DataFrame:
    """P10: crowd reaction per (news item, affected instrument).

    ``items``: url, ticker, sentiment_score, sentiment_label;
    ``ticker_sent``: ticker, published_date, sentiment_mean,
    sentiment_momentum_3d (the per-instrument daily sentiment, D4/E30);
    ``regime``: one row with ``regime_label`` (the current regime).
    Blended score 0.6 |item| + 0.4 |instrument mean| when the instrument
    has a sentiment row; counts and urgency scaled by regime multipliers.
    """
    m = REACTION_MULTIPLIERS
    x = items.join(ticker_sent.select("ticker", "published_date", "sentiment_mean", "sentiment_momentum_3d"),
                   ["ticker", "published_date"], "left")
    reg = regime.select(F.coalesce(F.col("regime_label"), F.lit("Neutral")).alias("regime"), F.lit(1).alias("__k"))
    x = x.withColumn("__k", F.lit(1)).join(F.broadcast(reg), "__k", "left").drop("__k") \
        .withColumn("regime", F.coalesce("regime", F.lit("Neutral")))

    def pick(i):
        return (F.when(F.col("regime") == "Bear", F.lit(m["Bear"][i]))
                .when(F.col("regime") == "Bull", F.lit(m["Bull"][i])).otherwise(F.lit(m["Neutral"][i])))
    score = F.abs(F.col("sentiment_score"))
    has = F.col("sentiment_mean").isNotNull()
    blended = F.when(has, score * 0.6 + F.abs("sentiment_mean") * 0.4).otherwise(score)
    mom = F.when(has, F.coalesce("sentiment_momentum_3d", F.lit(0.0))).otherwise(F.lit(0.0))
    base = F.greatest(F.lit(2000), F.floor(score * 10000.0))
    x = x.withColumns({"__u": pick(0), "__sell": pick(1), "__buy": pick(2), "__bl": blended, "__mom": mom,
                       "__base": base})
    neg = F.col("sentiment_label").isin("negative", "bearish")
    pos = F.col("sentiment_label").isin("positive", "bullish")
    u_neg = F.least((F.lit(0.5) + F.col("__bl") * 0.5) * F.col("__u"), F.lit(0.99))
    u_neg = F.when(F.col("__mom") > 0.1, F.least(u_neg + 0.1, F.lit(0.99))).otherwise(u_neg)
    c_neg = F.floor(F.col("__base") * F.col("__sell"))
    c_neg = F.when(F.col("__mom") > 0.1, F.floor(c_neg * 1.2)).otherwise(c_neg)
    u_pos = F.least((F.lit(0.4) + F.col("__bl") * 0.5) * F.col("__u"), F.lit(0.95))
    c_pos = F.floor(F.col("__base") * F.col("__buy"))
    urgency = F.when(neg, u_neg).when(pos, u_pos).otherwise(F.lit(0.3))
    count = F.when(neg, c_neg).when(pos, c_pos).otherwise(F.lit(2000)).cast("long")
    action = F.when(neg, "panic_sell").when(pos, "rush_buy").otherwise("hold")
    return x.select("url", "ticker", action.alias("action"), count.alias("agent_count"),
                    (F.round(urgency * 1000.0) / 1000.0).alias("urgency"), "regime")
