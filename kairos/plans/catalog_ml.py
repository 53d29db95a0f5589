"""Registered queries: regimes, action labels and model, topics (N1-N14,
D13, D17, D31, E35)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ml as N
from ..operators import windows as E
from ..operators.boost import Params
from ..registry import register
from ..sources import load
from . import fixtures as FX
from .silver import daily_features, silver_table
from .sqltext import BARS, SILVER, W, rows, with_ctes


def _bench(spark, sf):
    b = FX.bars_table(spark, sf).filter(F.col("ticker") == FX.BENCHMARK)
    return E.with_realised_vol(E.with_returns(b), ns=(20,))


@register("regime_features", sql=with_ctes(BARS, SILVER).rstrip() + f""",
b AS (SELECT * FROM silver WHERE ticker = 'MKT'),
f AS (SELECT dt, daily_return, realized_vol_20d, ABS(daily_return) AS abs_return,
             CASE WHEN COUNT(daily_return) {rows(5)} = 5 THEN AVG(daily_return) {rows(5)} END AS return_5d,
             (realized_vol_20d - LAG(realized_vol_20d) OVER ({W})) / NULLIF(LAG(realized_vol_20d) OVER ({W}), 0)
               AS vol_change,
             LN(1 + CAST(volume AS DOUBLE)) AS log_volume FROM b)
SELECT * FROM f WHERE daily_return IS NOT NULL AND realized_vol_20d IS NOT NULL AND return_5d IS NOT NULL
  AND vol_change IS NOT NULL AND log_volume IS NOT NULL""",
          floats=("daily_return", "realized_vol_20d", "abs_return", "return_5d", "vol_change", "log_volume"),
          ops=("N3",))
def q_regime_features(spark, sf):
    """Benchmark regime features."""
    return N.regime_features(_bench(spark, sf)).select(
        "dt", "daily_return", "realized_vol_20d", "abs_return", "return_5d", "vol_change", "log_volume")


@register("regimes", ops=("N2", "N4", "N5", "C9"))
def q_regimes(spark, sf):
    """Three-state Gaussian hidden Markov model on benchmark features, labelled
    by mean return, with the per-regime agent parameters."""
    r = N.detect_regimes(N.regime_features(_bench(spark, sf)), rounds=40)
    return N.with_regime_config(r.select("dt", "regime_id", "regime_label", "daily_return", "realized_vol_20d"))


@register("regime_paths", ops=("N2",))
def q_regime_paths(spark, sf):
    """Hidden Markov regimes of every instrument: one model each, all at once."""
    b = E.with_realised_vol(E.with_returns(FX.bars_table(spark, sf)), ns=(20,))
    r = N.detect_regimes(N.regime_features(b), rounds=12)
    return r.select("ticker", "dt", "regime_id", "regime_label")


@register("regime_states", ops=("N4", "N6"))
def q_regime_states(spark, sf):
    """Per-state statistics with the rule-based quiet/volatile label."""
    r = N.detect_regimes(N.regime_features(_bench(spark, sf)), rounds=40)
    return N.regime_rule_label(N.regime_stats(r))


@register("regime_transitions", sql=with_ctes(BARS, SILVER).rstrip() + """,
r AS (SELECT dt, """ + FX.REGIME_SQL + """
                      ELSE 'Neutral' END AS regime_label FROM silver WHERE ticker = 'MKT'),
p AS (SELECT LAG(regime_label) OVER (ORDER BY dt) AS prev_label, regime_label AS next_label FROM r)
SELECT prev_label, next_label, COUNT(*) AS n, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY prev_label) AS share
FROM p WHERE prev_label IS NOT NULL GROUP BY 1, 2""", floats=("share",), ops=("D17", "E35"))
def q_regime_transitions(spark, sf):
    """Transition counts between consecutive regime labels and row shares."""
    return N.regime_transitions(FX.regimes(silver_table(spark, sf)))


@register("label_actions", sql=with_ctes(BARS, SILVER).rstrip() + """,
l AS (SELECT ticker, dt, fwd_return_5d, realized_vol_20d * sqrt(5.0 / 252.0) * 1.0 AS premium FROM silver
      WHERE fwd_return_5d IS NOT NULL AND realized_vol_20d IS NOT NULL AND realized_vol_20d > 0),
p AS (SELECT ticker, dt, premium, fwd_return_5d AS buy_profit, -fwd_return_5d AS short_profit,
             GREATEST(0.0, fwd_return_5d) - premium AS call_profit, GREATEST(0.0, -fwd_return_5d) - premium AS put_profit
      FROM l)
SELECT *, CASE WHEN buy_profit >= short_profit AND buy_profit >= call_profit AND buy_profit >= put_profit THEN 'BUY'
               WHEN short_profit >= buy_profit AND short_profit >= call_profit AND short_profit >= put_profit THEN 'SHORT'
               WHEN call_profit >= put_profit THEN 'CALL' ELSE 'PUT' END AS optimal_action FROM p""",
          floats=("premium", "buy_profit", "short_profit", "call_profit", "put_profit"), ops=("N7",))
def q_label_actions(spark, sf):
    """Four action profits over 5 days and the best action."""
    df = E.with_forward_return(E.with_realised_vol(E.with_returns(FX.bars_table(spark, sf)), ns=(20,)), ns=(5,))
    return N.label_actions(df).select("ticker", "dt", "premium", "buy_profit", "short_profit", "call_profit",
                                      "put_profit", "optimal_action")


@register("time_split", sql=with_ctes(BARS).rstrip() + """,
d AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT dt FROM bars)),
c AS (SELECT dt AS cutoff FROM d WHERE i = CAST(FLOOR(n * (1.0 - 0.2)) AS INTEGER))
SELECT CAST(SUM(CASE WHEN b.dt >= c.cutoff THEN 1 ELSE 0 END) AS BIGINT) AS test_rows,
       CAST(SUM(CASE WHEN b.dt < c.cutoff THEN 1 ELSE 0 END) AS BIGINT) AS train_rows, MIN(c.cutoff) AS cutoff
FROM bars b, c""", ops=("N8",))
def q_time_split(spark, sf):
    """Time-ordered 80/20 split: train/test row counts and the cutoff."""
    s = N.time_split(FX.bars_table(spark, sf))
    return s.agg(F.sum(F.col("is_test").cast("int")).cast("long").alias("test_rows"),
                 F.sum((~F.col("is_test")).cast("int")).cast("long").alias("train_rows"),
                 F.min("cutoff").alias("cutoff"))


FEATURES = ["daily_return", "drawdown_pct", "drawdown_percentile", "realized_vol_20d", "vol_percentile",
            "volume_percentile", "rsi_14", "macd_histogram", "bb_pct_b", "roc_5", "roc_20", "zscore_20d",
            "relative_return_20d"]


# Query settings: fewer and smaller trees than the defaults (500 rounds of depth 5).
BOOST = Params(rounds=12, patience=5, rate=0.2, depth=3, bins=32)


def action_boost(spark, sf):
    """The boosted model, trained once per application and input version."""
    key = ("boost", spark.sparkContext.applicationId, sf, FX.stamp(spark, sf))
    if key not in FX._TABLES:
        FX._TABLES[key] = N.train_actions(N.time_split(N.label_actions(silver_table(spark, sf))), FEATURES, BOOST)
    return FX._TABLES[key]


def _test_scores(spark, sf):
    lab = N.time_split(N.label_actions(silver_table(spark, sf)))
    return N.score_actions(action_boost(spark, sf), lab.filter(F.col("is_test")).dropna(subset=FEATURES))


@register("action_model", ops=("N9", "N10", "D31", "B13"))
def q_action_model(spark, sf):
    """Boosted trees on the time split; per-class and summary metrics on
    the test dates, plus the predicted-action distribution."""
    pred = _test_scores(spark, sf)
    dist = pred.groupBy(F.col("ml_action").alias("cls")).agg(F.count(F.lit(1)).alias("predicted_rows"))
    return N.evaluate(pred).join(dist, "cls", "left")


@register("action_confusion", ops=("N10",))
def q_action_confusion(spark, sf):
    """Actual against predicted action on the test dates."""
    return N.confusion(_test_scores(spark, sf))


@register("action_importance", ops=("N10",))
def q_action_importance(spark, sf):
    """Total gain and splits of each feature."""
    return N.importances(spark, action_boost(spark, sf))


@register("action_curve", ops=("N9",))
def q_action_curve(spark, sf):
    """Learning and held-out loss after each round."""
    return spark.createDataFrame(action_boost(spark, sf).curve, "round int, train_loss double, held_out_loss double")


@register("action_scores", ops=("N11",))
def q_action_scores(spark, sf):
    """Probabilities, action and confidence of every row with complete features."""
    s = silver_table(spark, sf).dropna(subset=FEATURES)
    return N.score_actions(action_boost(spark, sf), s).select(
        "ticker", "dt", *[f"prob_{a.lower()}" for a in N.ACTIONS], "ml_action", "confidence", "model_version")


@register("action_coverage", ops=("D31",))
def q_action_coverage(spark, sf):
    """Predicted actions over all rows and the share of rows scored."""
    s = silver_table(spark, sf)
    return N.action_coverage(N.score_actions(action_boost(spark, sf), s.dropna(subset=FEATURES)), s)


@register("embedding_topics", ops=("N12",))
def q_embedding_topics(spark, sf):
    """Density clusters of the embedding table after a random projection,
    outliers as -1."""
    return N.cluster_embeddings(load(spark, sf, "embeddings"))


@register("topic_words", ops=("N13", "N14", "L8"))
def q_topic_words(spark, sf):
    """Class TF-IDF keywords per language class and their topic labels."""
    d = N.class_topics(load(spark, sf, "documents"))
    return N.assign_topics(N.topic_words(d))


@register("crosstab_labels", sql="""
SELECT quality, toxic, COUNT(*) AS n FROM labels GROUP BY CUBE (quality, toxic)""", ops=("D13",))
def q_crosstab(spark, sf):
    """Quality x toxic counts with margins."""
    return N.crosstab_margins(load(spark, sf, "labels"), "quality", "toxic")
