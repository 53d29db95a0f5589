"""Registered queries: news, posts, pages, macro (A9-A12, C15, C20, D2-D4,
D22, D26-D28, E28-E30, K1-K4, L1-L8, L11, N1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import news as NW
from ..operators.aggregates import summarise
from ..operators.joins import month_end, valid_symbols
from ..operators.windows import macro_features
from ..registry import register
from ..sources import load
from ..sources.files import dedupe_by, ingest_posts
from . import fixtures as FX
from .sqltext import BARS, SILVER, with_ctes

ARTICLES = """
articles AS (
  SELECT 'doc://' || CAST(doc_id AS VARCHAR) AS url, doc_id, text AS title, source, lang AS language,
         DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS published_date,
         CAST((n_chars % 201 - 100) / 10.0 AS DOUBLE) AS tone, lang AS scenario
  FROM documents)
"""


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _kw_sql(col):
    items = []
    for t, kws in FX.KEYWORDS.items():
        cond = " OR ".join(f"contains(lower({col}), '{k.lower()}')" for k in kws)
        items.append(f"CASE WHEN {cond} THEN '{t}' END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _lex_sql(col, neg, pos):
    nc = " + ".join(f"CAST(contains(lower({col}), '{w}') AS INTEGER)" for w in neg)
    pc = " + ".join(f"CAST(contains(lower({col}), '{w}') AS INTEGER)" for w in pos)
    return nc, pc


NC, PC = _lex_sql("title", FX.NEGATIVE_WORDS, FX.POSITIVE_WORDS)
EXPLODED = f"""
ex AS (SELECT * EXCLUDE (matched), UNNEST(matched) AS ticker
       FROM (SELECT articles.*, {_kw_sql('title')} AS matched FROM articles))
"""
SCORED = f"""
sc AS (
  SELECT *, CASE WHEN nc > pc THEN GREATEST(-0.5 - nc * 0.1, -1.0)
                 WHEN pc > nc THEN LEAST(0.5 + pc * 0.1, 1.0) ELSE 0.0 END AS sentiment_score,
         CASE WHEN nc > pc THEN 'negative' WHEN pc > nc THEN 'positive' ELSE 'neutral' END AS sentiment_label
  FROM (SELECT ex.*, {NC} AS nc, {PC} AS pc FROM ex))
"""
DAILY_NEWS = """
dn AS (
  SELECT ticker, published_date, COUNT(*) AS news_count, AVG(tone) AS avg_news_tone,
         COALESCE(STDDEV_SAMP(tone), 0.0) AS std_news_tone, MIN(tone) AS min_news_tone,
         MAX(tone) AS max_news_tone, COUNT(DISTINCT source) AS unique_sources,
         ARG_MIN(scenario, url) AS news_scenario
  FROM ex GROUP BY ticker, published_date)
"""


def _articles(spark, sf):
    return FX.articles(spark, sf)


def _exploded(spark, sf):
    return NW.explode_matches(_articles(spark, sf), "title", FX.KEYWORDS)


@register("keyword_match", sql=with_ctes(ARTICLES) + f"""
SELECT url, {_kw_sql('title')} AS matched_tickers, len({_kw_sql('title')}) AS ticker_count FROM articles""",
          ops=("L1", "U3", "B5"))
def q_keyword_match(spark, sf):
    """Instruments mentioned in each article (whole text, case-insensitive)."""
    a = _articles(spark, sf).withColumn("matched_tickers", TX.match_keywords("title", FX.KEYWORDS))
    return a.select("url", "matched_tickers", F.size("matched_tickers").alias("ticker_count"))


@register("daily_news", sql=with_ctes(ARTICLES, EXPLODED, DAILY_NEWS) + "SELECT * FROM dn",
          floats=("avg_news_tone", "std_news_tone", "min_news_tone", "max_news_tone"), ops=("D3", "L3"))
def q_daily_news(spark, sf):
    """Per (instrument, day) news statistics."""
    return NW.daily_news(_exploded(spark, sf))


@register("news_rolling", sql=with_ctes(ARTICLES, EXPLODED, DAILY_NEWS) + """
SELECT ticker, published_date,
  AVG(news_count) OVER (PARTITION BY ticker ORDER BY published_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS news_count_3d_avg,
  AVG(news_count) OVER (PARTITION BY ticker ORDER BY published_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS news_count_7d_avg,
  AVG(avg_news_tone) OVER (PARTITION BY ticker ORDER BY published_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS news_tone_3d_avg,
  avg_news_tone - LAG(avg_news_tone, 3) OVER (PARTITION BY ticker ORDER BY published_date) AS news_tone_delta_3d,
  CASE WHEN STDDEV_SAMP(news_count) OVER (PARTITION BY ticker ORDER BY published_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) > 0
       THEN (news_count - AVG(news_count) OVER (PARTITION BY ticker ORDER BY published_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
            / STDDEV_SAMP(news_count) OVER (PARTITION BY ticker ORDER BY published_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
       ELSE 0.0 END AS news_count_zscore
FROM dn""", floats=("news_count_3d_avg", "news_count_7d_avg", "news_tone_3d_avg", "news_tone_delta_3d",
                    "news_count_zscore"), ops=("E29",))
def q_news_rolling(spark, sf):
    """Rolling news counts and tone per instrument (rows with news)."""
    return NW.news_rolling(NW.daily_news(_exploded(spark, sf))).select(
        "ticker", "published_date", "news_count_3d_avg", "news_count_7d_avg", "news_tone_3d_avg",
        "news_tone_delta_3d", "news_count_zscore")


@register("news_counts", sql=with_ctes(ARTICLES, EXPLODED) + "SELECT ticker, COUNT(*) AS news_count FROM ex GROUP BY ticker",
          ops=("D22",))
def q_news_counts(spark, sf):
    """Articles per instrument."""
    return _exploded(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("news_count"))


@register("news_coverage", sql=with_ctes(ARTICLES, EXPLODED, DAILY_NEWS) + """
SELECT ticker, CAST(SUM(news_count) AS BIGINT) AS total_articles, ROUND(AVG(avg_news_tone), 4) AS avg_tone,
       COUNT(DISTINCT published_date) AS days_with_news, COUNT(DISTINCT news_scenario) AS scenarios
FROM dn GROUP BY ticker""", floats=("avg_tone",), ops=("D27",))
def q_news_coverage(spark, sf):
    """News coverage per instrument."""
    d = NW.daily_news(_exploded(spark, sf))
    return d.groupBy("ticker").agg(F.sum("news_count").cast("long").alias("total_articles"),
                                   F.round(F.avg("avg_news_tone"), 4).alias("avg_tone"),
                                   F.count_distinct("published_date").alias("days_with_news"),
                                   F.count_distinct("news_scenario").alias("scenarios"))


@register("lexicon_sentiment", sql=with_ctes(ARTICLES).rstrip() + f""",
s AS (SELECT url, {NC} AS nc, {PC} AS pc FROM articles)
SELECT url, nc AS neg_count, pc AS pos_count,
       CASE WHEN nc > pc THEN GREATEST(-0.5 - nc * 0.1, -1.0) WHEN pc > nc THEN LEAST(0.5 + pc * 0.1, 1.0)
            ELSE 0.0 END AS score,
       CASE WHEN nc > pc THEN 'negative' WHEN pc > nc THEN 'positive' ELSE 'neutral' END AS label
FROM s""", floats=("score",), ops=("L6", "L7", "N1"))
def q_lexicon(spark, sf):
    """Lexicon sentiment of every article (whole text)."""
    s = TX.lexicon_sentiment("title", FX.NEGATIVE_WORDS, FX.POSITIVE_WORDS)
    return _articles(spark, sf).select("url", *[v.alias(k) for k, v in s.items()])


@register("daily_sentiment", sql=with_ctes(ARTICLES, EXPLODED, SCORED).rstrip() + """,
ds AS (
  SELECT ticker, published_date, COUNT(*) AS news_count, AVG(sentiment_score) AS sentiment_mean,
         STDDEV_SAMP(sentiment_score) AS sentiment_std, MIN(sentiment_score) AS sentiment_min,
         MAX(sentiment_score) AS sentiment_max, AVG(ABS(sentiment_score)) AS avg_confidence,
         COUNT(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
         COUNT(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count,
         COUNT(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count
  FROM sc GROUP BY ticker, published_date)
SELECT ds.*, positive_count / news_count AS positive_ratio, COALESCE(sentiment_std, 0.0) AS sentiment_dispersion,
  sentiment_mean - LAG(sentiment_mean, 3) OVER (PARTITION BY ticker ORDER BY published_date) AS sentiment_delta_3d,
  AVG(sentiment_mean) OVER (PARTITION BY ticker ORDER BY published_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
    AS sentiment_momentum_3d
FROM ds""", floats=("sentiment_mean", "sentiment_std", "sentiment_min", "sentiment_max", "avg_confidence",
                    "positive_ratio", "sentiment_dispersion", "sentiment_delta_3d", "sentiment_momentum_3d"),
          ops=("D4", "E30", "N1", "U4"))
def q_daily_sentiment(spark, sf):
    """Scored articles aggregated per (instrument, day), with rolling deltas."""
    sc = NW.score_text(_exploded(spark, sf), "title", neg=FX.NEGATIVE_WORDS, pos=FX.POSITIVE_WORDS)
    return NW.sentiment_rolling(NW.daily_sentiment(sc))


@register("label_report", sql=with_ctes(ARTICLES, EXPLODED, SCORED) + """
SELECT scenario, sentiment_label, COUNT(*) AS n, AVG(sentiment_score) AS avg_score
FROM sc GROUP BY scenario, sentiment_label""", floats=("avg_score",), ops=("D28",))
def q_label_report(spark, sf):
    """Sentiment counts and mean score by scenario and label."""
    sc = NW.score_text(_exploded(spark, sf), "title", neg=FX.NEGATIVE_WORDS, pos=FX.POSITIVE_WORDS)
    return sc.groupBy("scenario", "sentiment_label").agg(F.count(F.lit(1)).alias("n"),
                                                         F.avg("sentiment_score").alias("avg_score"))


POSTS = """
posts AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, conv_id, turn, text AS title,
         '' AS selftext, CAST(length(text) AS BIGINT) AS score, turn AS num_comments,
         CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') + conv_id * 3600 AS DOUBLE) AS created_utc
  FROM conversations WHERE role = 'user')
"""


def _posts(spark, sf):
    p = FX.posts(spark, sf)
    return p.withColumns({"selftext": F.lit(""), "num_comments": F.col("turn")})


def _sym_sql(col):
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all({col}, '[\\pL\\pN_]+'), "
            f"lambda w: regexp_full_match(w, '[A-Z]{{2,5}}') AND list_contains({_sql_list(TX.SYMBOL_WHITELIST)}, w) "
            f"AND NOT list_contains({_sql_list(TX.SYMBOL_STOPWORDS)}, w))))")


@register("extract_symbols", sql=with_ctes(POSTS) + f"""
SELECT id, {_sym_sql("translate(title || ' $' || (" + _sql_list(TX.SYMBOL_WHITELIST) + ")[1 + conv_id % " + str(len(TX.SYMBOL_WHITELIST)) + "] || ' the ' || selftext, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")} AS symbols FROM posts""", ops=("L2",))
def q_extract_symbols(spark, sf):
    """Symbols mentioned in each post (upper-cased whole text); the invented
    prose holds none, so each post gets one, dealt by its conversation."""
    p = _posts(spark, sf)
    symbol = F.get(F.array(*[F.lit(s) for s in TX.SYMBOL_WHITELIST]), (F.col("conv_id") % len(TX.SYMBOL_WHITELIST)).cast("int"))
    whole = F.concat_ws("", "title", F.lit(" $"), symbol, F.lit(" the "), "selftext")
    return p.select("id", TX.extract_symbols(TX.ascii_upper(whole)).alias("symbols"))


@register("ingest_posts", sql=with_ctes(POSTS) + """
SELECT id AS post_id, title, selftext AS body, substr(selftext, 1, 500) AS body_preview,
       '[deleted]' AS author, score, created_utc, CAST(to_timestamp(created_utc) AS DATE) AS created_date
FROM posts
WHERE to_timestamp(created_utc) BETWEEN TIMESTAMPTZ '2024-01-01 00:00:00+00' AND TIMESTAMPTZ '2024-01-03 00:00:00+00'
""", ops=("A11", "K2", "L5"))
def q_ingest_posts(spark, sf):
    """Posts in the target period, deduped by id, with previews."""
    out = ingest_posts(_posts(spark, sf), "2024-01-01 00:00:00", "2024-01-03 00:00:00")
    return out.drop("created_ts")


@register("daily_activity", sql=with_ctes(POSTS) + """
SELECT CAST(to_timestamp(created_utc) AS DATE) AS created_date, COUNT(*) AS posts,
       CAST(SUM(score) AS BIGINT) AS total_score, CAST(SUM(num_comments) AS BIGINT) AS total_comments
FROM posts GROUP BY 1""", ops=("D26",))
def q_daily_activity(spark, sf):
    """Posts, summed score and comments per day."""
    p = _posts(spark, sf).withColumn("created_date", F.to_date(F.timestamp_seconds(F.col("created_utc").cast("long"))))
    return NW.daily_activity(p)


@register("valid_symbols", sql=with_ctes(POSTS).rstrip() + """,
cand AS (SELECT DISTINCT id, UNNEST(regexp_extract_all(translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[\\pL\\pN_]+')) AS symbol FROM posts),
uni AS (SELECT DISTINCT UNNEST(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[\\pL\\pN_]+')) AS w FROM benchmark)
SELECT id, symbol FROM cand WHERE regexp_full_match(symbol, '[A-Z]{2,5}') AND symbol IN (SELECT w FROM uni)""",
          ops=("C20",))
def q_valid_symbols(spark, sf):
    """Candidate symbols in posts that exist in the known word universe
    (2-5 capital-letter words of the benchmark table)."""
    p = _posts(spark, sf).select("id", F.explode(TX.candidate_symbols(TX.ascii_upper("title"))).alias("symbol"))
    uni = load(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(TX.ascii_upper("text"), F.lit(TX.WORD_RE), 0)).alias("ticker"))
    return valid_symbols(p, uni, "symbol", "ticker")


@register("html_text", sql="""
WITH c AS (
  SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
d AS (
  SELECT page_id, """ + "".join("regexp_replace(" for _ in range(6)) + "h" + "".join(
    f", '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')" for t in ("script", "style", "nav", "footer", "header", "aside")) + """ AS h
  FROM c),
e AS (
  SELECT page_id, CASE WHEN regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) <> ''
                       THEN regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)
                       ELSE array_to_string(regexp_extract_all(h, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1), ' ') END AS b
  FROM d)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
         regexp_replace(b, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
         '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text
FROM e""", ops=("A12",))
def q_html_text(spark, sf):
    """Article text of every raw page (whole text, no cut)."""
    return load(spark, sf, "pages").select("page_id", TX.html_to_text("html").alias("text"))


@register("dedupe_pages", sql="""
SELECT page_id, url FROM (
  SELECT page_id, url, ROW_NUMBER() OVER (PARTITION BY url ORDER BY page_id) AS r
  FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages UNION ALL SELECT page_id + 1000000, split_part(url, '?', 1) FROM pages
        UNION ALL SELECT page_id + 2000000, '' FROM pages)
  WHERE url IS NOT NULL AND url <> '') WHERE r = 1""", ops=("K1",))
def q_dedupe_pages(spark, sf):
    """One page per url without its query (first by id) of a table that holds
    every page twice; empty urls dropped."""
    p = load(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("url"))
    again = p.select((F.col("page_id") + 1_000_000).alias("page_id"), "url").unionByName(p.select((F.col("page_id") + 2_000_000).alias("page_id"), F.lit("").alias("url")))
    p = p.unionByName(again).filter(F.col("url").isNotNull() & (F.col("url") != ""))
    return dedupe_by(p, "url", "page_id")


@register("dedupe_documents", sql="""
SELECT doc_id, lang, n_chars FROM (
  SELECT doc_id, lang, n_chars, ROW_NUMBER() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)
WHERE r = 1""", ops=("K2",))
def q_dedupe_documents(spark, sf):
    """Exact-copy removal: one document per text hash (first by id)."""
    d = load(spark, sf, "documents").withColumn("h", F.md5("text")).select("doc_id", "lang", "n_chars", "h")
    return dedupe_by(d, "h", "doc_id").drop("h")


@register("distinct_pairs", sql="SELECT DISTINCT lang, source FROM documents", ops=("K3",))
def q_distinct_pairs(spark, sf):
    """Distinct (language, source) pairs."""
    return load(spark, sf, "documents").select("lang", "source").distinct()


@register("key_diff", sql="""
SELECT 'labels_only' AS side, doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
UNION ALL
SELECT 'documents_only' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""",
          ops=("K4", "C12"))
def q_key_diff(spark, sf):
    """Key-set difference both ways (labels vs documents)."""
    from ..operators.joins import missing_keys
    lab = load(spark, sf, "labels").select("doc_id")
    doc = load(spark, sf, "documents").select("doc_id")
    return missing_keys(lab, doc, "doc_id").select(F.lit("labels_only").alias("side"), "doc_id").unionByName(
        missing_keys(doc, lab, "doc_id").select(F.lit("documents_only").alias("side"), "doc_id"))


MACRO = """
macro AS (
  SELECT series_id, observation_date, CASE WHEN dayofmonth(observation_date) <> 13 THEN v END AS value
  FROM (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observation_date, MAX(o_totalprice) AS v
        FROM orders GROUP BY 1, 2))
"""


@register("macro_features", sql=with_ctes(MACRO) + """
SELECT series_id, observation_date, value,
  value - LAG(value) OVER (PARTITION BY series_id ORDER BY observation_date) AS daily_change,
  CASE WHEN LAG(value) OVER (PARTITION BY series_id ORDER BY observation_date) IS NOT NULL
        AND LAG(value) OVER (PARTITION BY series_id ORDER BY observation_date) <> 0
       THEN (value - LAG(value) OVER (PARTITION BY series_id ORDER BY observation_date))
            / LAG(value) OVER (PARTITION BY series_id ORDER BY observation_date) END AS pct_change,
  CASE WHEN STDDEV_SAMP(value) OVER w > 0 THEN (value - AVG(value) OVER w) / STDDEV_SAMP(value) OVER w
       ELSE 0.0 END AS zscore_20d
FROM macro
WINDOW w AS (PARTITION BY series_id ORDER BY observation_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
          floats=("value", "daily_change", "pct_change", "zscore_20d"), ops=("A9", "E28"))
def q_macro_features(spark, sf):
    """Macro series changes and rolling z-score."""
    return macro_features(FX.macro(spark, sf))


@register("month_end", sql=with_ctes(MACRO) + """
SELECT series_id, observation_date, value FROM macro
WHERE (series_id, observation_date) IN (
  SELECT (series_id, MAX(observation_date)) FROM macro GROUP BY series_id, year(observation_date), month(observation_date))""",
          floats=("value",), ops=("C15", "L15"))
def q_month_end(spark, sf):
    """Last observation of each series in each month."""
    return month_end(FX.macro(spark, sf))


@register("macro_summary", sql=with_ctes(MACRO) + """
SELECT series_id, COUNT(*) AS n, ROUND(AVG(value), 4) AS avg_value, ROUND(MIN(value), 4) AS min_value,
       ROUND(MAX(value), 4) AS max_value, ROUND(STDDEV_SAMP(value), 4) AS std_value
FROM macro GROUP BY series_id""", floats=("avg_value", "min_value", "max_value", "std_value"), digits=2,
          ops=("D2",))
def q_macro_summary(spark, sf):
    """Grouped rounded summary per series."""
    return summarise(FX.macro(spark, sf), "series_id", "value")


@register("json_props", sql="""
SELECT event_id, COALESCE(TRY_CAST(json_extract_string(regexp_extract(props, '(?s)(\\{.*\\})', 1), '$.k') AS INTEGER), 0) AS k
FROM events""", ops=("L11",))
def q_json_props(spark, sf):
    """Parse the JSON object in each event's text field; bad number -> 0."""
    ev = load(spark, sf, "events")
    parsed = TX.parse_json_reply("props", "k STRING")
    return ev.withColumn("__p", parsed).select(
        "event_id", F.coalesce(F.expr("try_cast(__p.k AS INT)"), F.lit(0)).alias("k"))


@register("agent_reaction", sql=with_ctes(ARTICLES, EXPLODED, SCORED).rstrip() + """,
""" + BARS.strip() + """,
""" + SILVER.strip() + """,
ds AS (SELECT ticker, published_date, AVG(sentiment_score) AS sentiment_mean FROM sc GROUP BY 1, 2),
dm AS (SELECT *, AVG(sentiment_mean) OVER (PARTITION BY ticker ORDER BY published_date
                                           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mom FROM ds),
rg AS (SELECT """ + FX.REGIME_SQL + """
                   ELSE 'Neutral' END AS regime
       FROM silver WHERE ticker = 'MKT' AND dt = (SELECT MAX(dt) FROM silver WHERE ticker = 'MKT')),
x AS (SELECT sc.url, sc.ticker, sc.sentiment_label, ABS(sc.sentiment_score) AS score, dm.sentiment_mean, dm.mom,
             COALESCE(rg.regime, 'Neutral') AS regime
      FROM sc LEFT JOIN dm ON sc.ticker = dm.ticker AND sc.published_date = dm.published_date
      LEFT JOIN rg ON TRUE),
y AS (SELECT *, CASE regime WHEN 'Bear' THEN 1.3 WHEN 'Bull' THEN 0.9 ELSE 1.0 END AS um,
             CASE regime WHEN 'Bear' THEN 1.5 WHEN 'Bull' THEN 0.7 ELSE 1.0 END AS sb,
             CASE regime WHEN 'Bear' THEN 0.6 WHEN 'Bull' THEN 1.4 ELSE 1.0 END AS bb,
             CASE WHEN sentiment_mean IS NOT NULL THEN score * 0.6 + ABS(sentiment_mean) * 0.4 ELSE score END AS bl,
             CASE WHEN sentiment_mean IS NOT NULL THEN COALESCE(mom, 0.0) ELSE 0.0 END AS mo,
             GREATEST(2000, FLOOR(score * 10000.0)) AS base FROM x)
SELECT url, ticker,
  CASE WHEN sentiment_label IN ('negative', 'bearish') THEN 'panic_sell'
       WHEN sentiment_label IN ('positive', 'bullish') THEN 'rush_buy' ELSE 'hold' END AS action,
  CAST(CASE WHEN sentiment_label IN ('negative', 'bearish') THEN
              CASE WHEN mo > 0.1 THEN FLOOR(FLOOR(base * sb) * 1.2) ELSE FLOOR(base * sb) END
            WHEN sentiment_label IN ('positive', 'bullish') THEN FLOOR(base * bb) ELSE 2000 END AS BIGINT) AS agent_count,
  ROUND(CASE WHEN sentiment_label IN ('negative', 'bearish') THEN
               CASE WHEN mo > 0.1 THEN LEAST(LEAST((0.5 + bl * 0.5) * um, 0.99) + 0.1, 0.99)
                    ELSE LEAST((0.5 + bl * 0.5) * um, 0.99) END
             WHEN sentiment_label IN ('positive', 'bullish') THEN LEAST((0.4 + bl * 0.5) * um, 0.95)
             ELSE 0.3 END * 1000.0) / 1000.0 AS urgency,
  regime
FROM y""", floats=("urgency",), ops=("P10",))
def q_agent_reaction(spark, sf):
    """Crowd reaction to every news item per affected instrument, scaled by
    the current (latest) benchmark regime."""
    from ..operators.ranking import latest_snapshot
    from .silver import silver_table
    sc = NW.score_text(_exploded(spark, sf), "title", neg=FX.NEGATIVE_WORDS, pos=FX.POSITIVE_WORDS)
    ds = sc.groupBy("ticker", "published_date").agg(F.avg("sentiment_score").alias("sentiment_mean"))
    ds = NW.sentiment_rolling(ds)
    reg = latest_snapshot(FX.regimes(silver_table(spark, sf)))
    return NW.agent_reaction(sc.select("url", "ticker", "published_date", "sentiment_score", "sentiment_label"),
                             ds, reg)
