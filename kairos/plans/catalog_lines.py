"""Registered queries: tables written in the line formats of the sources and
read back by them, as a batch and as a stream (A4, A9, A13, G16, L9, L10, P17);
quantiles from stored sketches (D8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import reports as R
from ..operators import sketches as K
from ..registry import register
from ..session import checkpoint_dir
from ..sources import files, lines, load
from ..streaming import jobs
from . import fixtures as FX
from .catalog_text import MACRO
from .sqltext import with_ctes


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/sources/{name}-{uuid.uuid4().hex}"


def _macro_files(spark, sf) -> str:
    """The macro series as documents, one for each series and year (a
    calendar's bound). Days 7 hold a value and days 21 a date that can't be
    read, and each document is followed by a line that is no document."""
    m = FX.macro(spark, sf)
    day = F.dayofmonth("observation_date")
    value = F.when(day == 7, "n/a").otherwise(F.coalesce(F.col("value").cast("string"), F.lit(".")))
    date = F.when(day == 21, "unknown").otherwise(F.col("observation_date").cast("string"))
    one = F.struct(F.col("observation_date"), date.alias("date"), value.alias("value"))
    g = m.groupBy("series_id", F.year("observation_date").alias("y")).agg(F.array_sort(F.collect_list(one)).alias("o"))
    doc = F.to_json(F.struct("series_id", F.transform("o", lambda x: F.struct(x["date"].alias("date"), x["value"].alias("value"))).alias("observations")))
    path = _folder(spark, "macro")
    g.select(F.explode(F.array(doc, F.concat(F.lit("{broken "), F.col("series_id")))).alias("value")).write.text(path)
    return path


READ_BACK = """
rb AS (SELECT series_id, CASE WHEN day(observation_date) <> 21 THEN observation_date END AS observation_date,
              CASE WHEN day(observation_date) <> 7 THEN value END AS value FROM macro)
"""


@register("macro_source", sql=with_ctes(MACRO, READ_BACK) + "SELECT * FROM rb", floats=("value",), ops=("A9",))
def q_macro_source(spark, sf):
    """Macro documents read by the partitioned line source."""
    return lines.macro_rows(lines.read_lines(spark, _macro_files(spark, sf), "observations"))


@register("macro_problems", sql=with_ctes(MACRO) + """
SELECT CASE day(observation_date) WHEN 7 THEN 'value' WHEN 21 THEN 'date' END AS problem, COUNT(*) AS rows FROM macro GROUP BY 1
UNION ALL SELECT 'document' AS problem, COUNT(*) AS rows FROM (SELECT DISTINCT series_id, year(observation_date) FROM macro)""", ops=("A9",))
def q_macro_problems(spark, sf):
    """Bad rows of the macro documents, counted by kind."""
    return lines.problem_counts(lines.read_lines(spark, _macro_files(spark, sf), "observations"))


@register("macro_stream", sql=with_ctes(MACRO, READ_BACK) + "SELECT * FROM rb", floats=("value",), ops=("A9",))
def q_macro_stream(spark, sf):
    """The same documents as a stream over their files."""
    stream = lines.stream_lines(spark, _macro_files(spark, sf), "observations", settleSeconds="0")
    return lines.macro_rows(jobs.run_batches(stream, jobs.shared_path(spark, "macro"), schema=lines.stream_schema("observations")))


# Comments dealt to the events, the event number behind them.
COMMENTS = ["", "won at event ", "note of event ", "Oversold RSI at event ", "breakout after earnings at event ", "bought the dip but lost at event "]


def _pick(options):
    return F.get(F.array(*options), (F.col("event_id") % len(options)).cast("int"))


def _trade_files(spark, sf) -> str:
    """Events as a broker export: event type = symbol (some are too long to be
    one), every fourth user without a side, and profits that are no number or
    have a unit behind it."""
    e = load(spark, sf, "events")
    k = F.col("event_id") % 50
    number = F.round(F.col("value") - 10, 2).cast("decimal(18,2)").cast("string")
    out = e.select(F.date_format("ts", "yyyy-MM-dd").alias("Trade Date"), F.col("event_type").alias("Symbol"),
                   F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 == 1, "sell").otherwise("buy").alias("Side"),
                   F.when(k == 0, "n/a").when(k == 1, F.concat(number, F.lit(" USD"))).otherwise(number).alias("P&L"),
                   _pick([F.concat(F.lit(w), F.col("event_id").cast("string")) if w else F.lit("") for w in COMMENTS]).alias("Comment"))
    path = _folder(spark, "trades")
    out.write.option("header", True).option("emptyValue", "").csv(path)
    return path


def _any(words):
    return "(" + " OR ".join(f"contains(lower(notes), '{w}')" for w in words) + ")"


TRADES = """
tr AS (SELECT upper(event_type) AS ticker, CASE user_id % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'BUY' END AS action, strftime(ts, '%Y-%m-%d') AS date,
              CASE WHEN event_id % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(CAST(round(value - 10, 2) AS DECIMAL(18, 2)) AS DOUBLE) END AS profit,
              CASE event_id % 6 """ + " ".join(f"WHEN {i} THEN '{w}' || event_id" for i, w in enumerate(COMMENTS) if w) + """ END AS given, event_id
       FROM events),
td AS (SELECT *, CASE WHEN profit > 0 THEN 'win' WHEN profit < 0 THEN 'loss' WHEN """ + _any(TX.WIN_WORDS) + """ THEN 'win' WHEN """ + _any(TX.LOSS_WORDS) + """ THEN 'loss' ELSE 'open' END AS outcome
       FROM (SELECT ticker, action, date, profit, COALESCE(given, action || ' ' || ticker) AS notes, event_id FROM tr WHERE length(ticker) <= 5)),
pt AS (SELECT ticker, profit, outcome, UNNEST(CASE WHEN len(tags) = 0 THEN ['Discretionary'] ELSE tags END) AS pattern
       FROM (SELECT *, list_filter([""" + ", ".join(f"CASE WHEN {_any(ws)} THEN '{t}' END" for ws, t in TX.PATTERN_RULES) + """], lambda x: x IS NOT NULL) AS tags FROM td))
"""


def _trades(spark, sf):
    """Trades of the exports with their patterns; the outcome by profit, else by the notes."""
    t = lines.trade_rows(lines.read_lines(spark, _trade_files(spark, sf), "broker_csv"))
    tags = TX.tag_patterns("notes")
    return t.withColumns({"patterns": tags["patterns"], "outcome": F.when(F.col("profit") > 0, "win").when(F.col("profit") < 0, "loss").otherwise(tags["outcome"])})


@register("broker_trades", sql=with_ctes(TRADES) + "SELECT ticker, action, date, profit, notes, outcome FROM td", floats=("profit",), ops=("A13", "L10"))
def q_broker_trades(spark, sf):
    """Trades of broker exports with their outcome."""
    return _trades(spark, sf).select("ticker", "action", "date", "profit", "notes", "outcome")


@register("journal_stats", sql=with_ctes(TRADES) + """
SELECT pattern, COUNT(*) AS trades, CAST(COUNT(*) FILTER (WHERE outcome = 'win') AS BIGINT) AS wins, SUM(profit) AS total_profit,
       COUNT(*) FILTER (WHERE outcome = 'win') / CAST(COUNT(*) AS DOUBLE) AS win_rate FROM pt GROUP BY pattern
UNION ALL
SELECT '__all__' AS pattern, COUNT(*) AS trades, CAST(COUNT(*) FILTER (WHERE outcome = 'win') AS BIGINT) AS wins, SUM(profit) AS total_profit,
       COUNT(*) FILTER (WHERE outcome = 'win') / CAST(COUNT(*) AS DOUBLE) AS win_rate FROM td""", floats=("total_profit", "win_rate"), ops=("P17", "L10"))
def q_journal_stats(spark, sf):
    """Trades, wins and profit of each pattern of the journal, and of all."""
    return R.journal_stats(_trades(spark, sf))


@register("pattern_graph", sql=with_ctes(TRADES) + """
SELECT ticker AS src, pattern AS dst, CAST(COUNT(*) AS DOUBLE) AS weight, 'ticker_pattern' AS kind FROM pt GROUP BY 1, 2
UNION ALL
SELECT pattern AS src, outcome AS dst, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY pattern) AS weight, 'pattern_outcome' AS kind FROM pt GROUP BY 1, 2""",
          floats=("weight",), ops=("G16",))
def q_pattern_graph(spark, sf):
    """Edges from tickers to patterns and from patterns to outcomes."""
    return R.pattern_graph(_trades(spark, sf))


@register("trade_notes", sql="""
WITH e AS (SELECT event_id, upper(left(event_type, 4)) AS s, event_id % 4 AS k FROM events)
SELECT event_id AS note_id, 0 AS trade_no, s AS ticker, CASE k WHEN 2 THEN 'SHORT' ELSE 'BUY' END AS action, CASE k WHEN 2 THEN '2024-03-01' END AS date,
       CASE k WHEN 0 THEN 'Buy ' || s || ' now held at event ' || event_id WHEN 1 THEN 'watching $' || s || ' sold on 2024-01-05'
              WHEN 2 THEN 'short ' || s || ' 2024-03-01 covered' ELSE 'Mentioned in notes: ' || s END AS notes FROM e
UNION ALL
SELECT event_id AS note_id, 1 AS trade_no, 'SPY' AS ticker, 'LONG' AS action, NULL AS date, 'long $SPY later' AS notes FROM e WHERE k = 2""", ops=("L9",))
def q_trade_notes(spark, sf):
    """Trades found in free-text notes, one note for each event, of four forms."""
    s = F.upper(F.substring("event_type", 1, 4))
    note = F.get(F.array(F.concat(F.lit("Buy "), s, F.lit(" now\n\n  held at event "), F.col("event_id").cast("string")),
                         F.concat(F.lit("a quiet day\nwatching $"), s, F.lit("\nsold on 2024-01-05")),
                         F.concat(F.lit("short "), s, F.lit(" 2024-03-01\ncovered\nlong $SPY later")),
                         F.concat(s, F.lit(" seen by THE desk"))), (F.col("event_id") % 4).cast("int"))
    return TX.parse_trade_notes(load(spark, sf, "events").select(F.col("event_id").alias("note_id"), note.alias("text")))


@register("broker_problems", sql=with_ctes(TRADES) + """
SELECT CASE WHEN length(ticker) > 5 THEN 'ticker' WHEN event_id % 50 < 2 THEN 'profit' END AS problem, COUNT(*) AS rows FROM tr GROUP BY 1""", ops=("A13",))
def q_broker_problems(spark, sf):
    """Rows of the broker exports by problem."""
    return lines.problem_counts(lines.read_lines(spark, _trade_files(spark, sf), "broker_csv"))


@register("stored_quantiles", sql="""
SELECT l_returnflag, p, COUNT(*) AS n, TRUE AS within FROM lineitem, (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9), (0.99)) AS t(p)
WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag, p""", ops=("D8",))
def q_stored_quantiles(spark, sf):
    """Price quantiles of each return flag from one stored sketch a day; within:
    the estimate's true rank is at most the stated error from the wanted one."""
    li = load(spark, sf, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), "l_extendedprice")
    path = _folder(spark, "sketches")
    K.store_sketches(li, path, ["l_returnflag"], "day", "l_extendedprice")
    q = K.sketched_quantiles(spark.read.parquet(path), ["l_returnflag"], [0.1, 0.5, 0.9, 0.99])
    r = K.rank_interval(li, ["l_returnflag"], "l_extendedprice", q)
    within = (F.col("below") <= F.col("p") + K.RANK_ERROR) & (F.col("up_to") >= F.col("p") - K.RANK_ERROR)
    return r.select("l_returnflag", "p", "n", within.alias("within"))


@register("clean_metadata", sql="""
SELECT ticker, sector, CASE WHEN k % 4 IN (0, 1) THEN CAST(0 AS DOUBLE) ELSE cap END AS market_cap
FROM (SELECT p_partkey AS k, p_brand || '-' || p_partkey AS ticker, p_type AS sector, p_retailprice AS cap FROM part)""", floats=("market_cap",), ops=("A4",))
def q_clean_metadata(spark, sf):
    """Instrument metadata written as CSV with padded text and, in places, no
    market cap or an unreadable one; read back clean."""
    pt = load(spark, sf, "part")
    k = F.col("p_partkey") % 4
    cap = F.when(k == 0, "").when(k == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string")))
    path = _folder(spark, "metadata")
    pt.select(F.concat(F.lit("  "), "p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("ticker"), F.concat("p_type", F.lit("  ")).alias("sector"),
              cap.alias("market_cap")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_metadata(spark, path)
