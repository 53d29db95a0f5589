"""Registered queries: Structured Streaming operators drained with
``availableNow`` and compared with the batch answer (I1-I8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..registry import register
from ..sources import load
from ..streaming import jobs as S
from . import fixtures as FX
from .catalog_decide import FLOWS
from .sqltext import BARS, SILVER, with_ctes


def _events_stream(spark, sf, end_after=None):
    # Event time must be a TIMESTAMP (the table stores wall-clock time;
    # the session runs in UTC, so the instant is the same).
    ev = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = S.stage_by_day(ev, "ts", "events", end_after)
    schema = T.StructType(ev.schema.fields + [T.StructField("day", T.DateType())])
    return S.read_stream(spark, path, schema)


@register("windowed_news_stream", sql="""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS n, AVG(value) AS avg_value
FROM events GROUP BY 1, 2, 3""", floats=("avg_value",), ops=("I7",))
def q_windowed(spark, sf):
    """Tumbling 1-hour event-time windows per type, watermark 2 hours."""
    st = _events_stream(spark, sf, end_after="5 days")
    return S.run_to_table(S.windowed_counts(st, kind="tumbling"), S.shared_path(spark, "tumbling"))


@register("sliding_window_stream", sql="""
WITH b AS (SELECT ts, event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) AS s0 FROM events),
w AS (SELECT s0 AS window_start, event_type, value FROM b
      UNION ALL SELECT s0 - INTERVAL 30 MINUTE, event_type, value FROM b)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS n, AVG(value) AS avg_value
FROM w GROUP BY 1, 2, 3""", floats=("avg_value",), ops=("I7",))
def q_sliding(spark, sf):
    """Sliding 1-hour windows every 30 minutes."""
    st = _events_stream(spark, sf, end_after="5 days")
    return S.run_to_table(S.windowed_counts(st, kind="sliding"), S.shared_path(spark, "sliding"))


@register("session_window_stream", sql="""
WITH o AS (SELECT ts, user_id, value, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pts FROM events),
g AS (SELECT *, SUM(CASE WHEN pts IS NULL OR ts >= pts + INTERVAL 12 HOUR THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)
SELECT MIN(ts) AS window_start, MAX(ts) + INTERVAL 12 HOUR AS window_end, user_id, COUNT(*) AS n,
       AVG(value) AS avg_value
FROM g GROUP BY user_id, sid""", floats=("avg_value",), ops=("I7",))
def q_session(spark, sf):
    """Session windows of each user with a 12-hour gap."""
    st = _events_stream(spark, sf, end_after="5 days")
    return S.run_to_table(S.windowed_counts(st, kind="session", by=("user_id",), gap="12 hours"), S.shared_path(spark, "session"))


@register("stream_dedupe", sql="""
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS r FROM events)
WHERE r = 1""", ops=("I8", "K1"))
def q_stream_dedupe(spark, sf):
    """The first event of each (user, type) in each hour."""
    st = _events_stream(spark, sf, end_after="5 days")
    return S.run_to_table(S.stream_dedupe(st.drop("day"), ["user_id", "event_type"]), S.shared_path(spark, "dedupe"))


@register("stream_leaderboard", sql="""
SELECT user_id, COUNT(*) AS trades, COUNT(*) FILTER (WHERE value - 10 >= 0) AS wins, SUM(value - 10) AS profit,
       MAX(ts) AS last_trade FROM events GROUP BY user_id""", floats=("profit",), ops=("I6",))
def q_leaderboard(spark, sf):
    """Running totals of each agent in update mode, with the profit of the
    batch leaderboard; the final state of each agent."""
    st = _events_stream(spark, sf).withColumn("profit", F.col("value") - 10)
    return S.run_to_table(S.leaderboard(st), S.shared_path(spark, "leaderboard"), mode="update", key_cols=["user_id"])


@register("stream_quality", sql="""
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS rows, COUNT(*) FILTER (WHERE value IS NULL) AS null_values,
       COUNT(*) FILTER (WHERE value < 0) AS negative_values, COUNT(DISTINCT user_id) AS users
FROM events GROUP BY 1""", ops=("I3", "M1"))
def q_stream_quality(spark, sf):
    """Rule checks of every day, put together from all micro-batches."""
    return S.stream_quality(_events_stream(spark, sf), S.shared_path(spark, "quality"))


@register("stream_news", sql=f"""
WITH p AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text FROM conversations WHERE role = 'user'),
s AS (SELECT id, {' + '.join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in FX.NEGATIVE_WORDS)} AS nc,
             {' + '.join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in FX.POSITIVE_WORDS)} AS pc,
             translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up FROM p),
c AS (SELECT id, nc, pc, UNNEST(list_distinct(list_filter(regexp_extract_all(up, '[\\pL\\pN_]+'),
                                      lambda w: regexp_full_match(w, '[A-Z]{{2,5}}')))) AS symbol FROM s),
uni AS (SELECT DISTINCT UNNEST(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz',
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[\\pL\\pN_]+')) AS w FROM benchmark)
SELECT id, symbol, CASE WHEN nc > pc THEN GREATEST(-0.5 - nc * 0.1, -1.0) WHEN pc > nc THEN LEAST(0.5 + pc * 0.1, 1.0)
                        ELSE 0.0 END AS score,
       CASE WHEN nc > pc THEN 'negative' WHEN pc > nc THEN 'positive' ELSE 'neutral' END AS label
FROM c WHERE symbol IN (SELECT w FROM uni)""", floats=("score",), ops=("I4", "L6", "L2", "C20"))
def q_stream_news(spark, sf):
    """News push: each incoming post is scored, its symbols extracted and
    checked against the known universe (stream-static semi join)."""
    p = FX.posts(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("created_utc").cast("long")))
    path = S.stage_by_day(p.select("id", "title", "ts"), "ts", "posts")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
                           T.StructField("ts", T.TimestampType()), T.StructField("day", T.DateType())])
    st = S.read_stream(spark, path, schema, bytes_per_batch=128 << 20)  # the posts of a day are few
    s = TX.lexicon_sentiment("title", FX.NEGATIVE_WORDS, FX.POSITIVE_WORDS)
    st = st.select("id", s["score"].alias("score"), s["label"].alias("label"),
                   F.explode(TX.candidate_symbols(TX.ascii_upper("title"))).alias("symbol"))
    uni = load(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(TX.ascii_upper("text"), F.lit(TX.WORD_RE), 0)).alias("w")).distinct()
    st = st.join(uni, st.symbol == uni.w, "left_semi")
    return S.run_to_table(st.select("id", "symbol", "score", "label"), S.shared_path(spark, "news"))


@register("advance_days", sql=with_ctes(BARS, SILVER, """
first_day AS (SELECT MIN(dt) AS d0 FROM (SELECT dt FROM silver GROUP BY dt HAVING COUNT(DISTINCT ticker) >= 10))""") + """
SELECT ticker, dt, close,
       CASE WHEN drawdown_percentile > 0.80 THEN 1 ELSE 0 END
       + CASE WHEN drawdown_percentile > 0.85 AND volume_percentile > 0.90 AND vol_percentile > 0.85 THEN 1 ELSE 0 END
       + CASE WHEN drawdown_percentile > 0.85 AND fwd_return_60d > 0.05 AND fwd_return_5d > -0.03 THEN 1 ELSE 0 END
       + CASE WHEN drawdown_percentile > 0.80 AND roc_20 < -0.05 AND roc_5 > roc_20 THEN 1 ELSE 0 END
       + CASE WHEN drawdown_percentile > 0.90 AND volume_percentile > 0.90 AND vol_percentile > 0.85 AND roc_20 < -0.08
                   AND fwd_return_60d > 0.10 THEN 1 ELSE 0 END AS signal_score
FROM silver WHERE dt >= (SELECT d0 FROM first_day)""", floats=("close",), ops=("I1", "I2", "A18", "F12"))
def q_advance(spark, sf):
    """Incremental gold: from the reset date (first date with >= 10
    instruments) every date is scored by the one-day scorer."""
    from ..operators.signals import day_score
    from .silver import silver_table
    silver = silver_table(spark, sf)
    start = S.reset_start_date(silver, 10).first()["start_date"]
    scored = lambda days: day_score(days).select("ticker", "dt", "close", "signal_score")
    path = S.shared_path(spark, "gold-advance")
    if start is None or not S.advance(silver, path, scored, days=None, start=start):
        return scored(silver.limit(0))
    return S.gold_rows(spark, path).select("ticker", "dt", "close", "signal_score")


@register("stream_flows", sql=FLOWS + """
SELECT * FROM (
  SELECT flows.*, ROW_NUMBER() OVER (PARTITION BY scenario_id, dt ORDER BY urgency DESC, archetype_id) AS rank
  FROM flows) WHERE rank <= 10""", floats=("urgency", "confidence", "stock_score"), ops=("I5", "P9"))
def q_stream_flows(spark, sf):
    """Flow requests (one per scenario date) arriving as a stream, each
    answered with the top 10 decisions of its date."""
    from ..session import materialize
    from .catalog_decide import flows
    fl = materialize(flows(spark, sf))
    req = fl.select("scenario_id", "dt").distinct().withColumn("ts", F.col("dt").cast("timestamp"))
    path = S.stage_by_day(req, "ts", "requests")
    schema = T.StructType([T.StructField("scenario_id", T.IntegerType()), T.StructField("dt", T.DateType()),
                           T.StructField("ts", T.TimestampType()), T.StructField("day", T.DateType())])
    return S.stream_flows(S.read_stream(spark, path, schema, files_per_batch=64), fl, S.shared_path(spark, "flows"))
