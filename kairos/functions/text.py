"""Text helpers (L1-L11): keyword and symbol matching, lexicon sentiment,
HTML to text, note parsing. All JVM-side expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import col_

# Symbol whitelist and stop words for post symbol extraction.
SYMBOL_WHITELIST = [
    "GME", "AMC", "BB", "NOK", "BBBY", "PLTR", "TSLA", "AAPL", "MSFT",
    "NVDA", "AMD", "SPY", "QQQ", "AMZN", "GOOGL", "META", "NFLX",
    "SLV", "SPCE", "WISH", "CLOV", "SOFI", "LCID", "RIVN", "DKNG",
    "CRSR", "RKT", "UWMC", "SNDL", "TLRY", "APHA", "EXPR", "KOSS",
    "NAKD", "TR", "WKHS", "RIDE", "GOEV", "NIO", "XPEV", "LI",
]
SYMBOL_STOPWORDS = [
    "THE", "AND", "FOR", "ARE", "BUT", "NOT", "YOU", "ALL", "CAN", "HER",
    "WAS", "ONE", "OUR", "OUT", "HAS", "HIS", "HOW", "ITS", "MAY", "NEW",
    "NOW", "OLD", "SEE", "WAY", "WHO", "DID", "GET", "HIM", "LET", "SAY",
    "SHE", "TOO", "USE", "DAD", "MOM", "BIG", "END", "FAR", "FEW", "GOT",
    "HAD", "MAN", "RAN", "RED", "RUN", "SET", "TOP", "TRY", "WON", "YET",
    "BUY", "PUT", "CALL", "HOLD", "YOLO", "MOON", "HODL", "GAIN", "LOSS",
    "EDIT", "JUST", "LIKE", "THIS", "THAT", "WILL", "WITH", "HAVE", "FROM",
    "BEEN", "THEY", "SOME", "THEM", "THAN", "WHAT", "WHEN", "MAKE", "EACH",
    "MORE", "VERY", "MUCH", "LONG", "OVER", "SUCH", "TAKE", "INTO",
    "YEAR", "BACK", "ALSO", "NEXT", "LAST", "ONLY", "EVEN", "MOST",
    "KEEP", "WANT", "GIVE", "MANY", "WELL", "STILL", "SHOULD", "COULD",
    "WOULD", "THEIR", "ABOUT", "AFTER", "THINK", "SHARE", "STOCK",
    "MARKET", "MONEY", "SHORT", "PRICE", "TODAY", "GOING", "HEDGE",
    "TRADE", "NEVER", "EVERY", "FIRST", "THESE", "OTHER", "THOSE",
    "BEING", "WHERE", "THERE", "WHICH", "GREAT", "RIGHT", "STILL",
    "BASED", "SINCE", "WHILE", "UNTIL", "ABOVE", "BELOW",
    "USA", "SEC", "NYSE", "CEO", "CFO", "IPO", "ETF", "OTC",
    "GDP", "FED", "IMO", "TIL", "PSA", "LMAO", "STFU", "GTFO",
]

# Default news lexicon (fallback sentiment scorer).
NEGATIVE_WORDS = ["crash", "bankruptcy", "explodes", "fraud", "scandal",
                  "layoffs", "recall", "lawsuit", "plunge", "collapse",
                  "fire", "death", "hack", "breach", "fail"]
POSITIVE_WORDS = ["soars", "record", "breakthrough", "profit", "growth",
                  "innovation", "partnership", "acquisition", "surge", "boom",
                  "beats", "upgrade", "bullish", "rally", "expansion"]

# Ordered topic label rules (keywords -> label).
TOPIC_RULES = [
    (["covid", "pandemic", "virus", "coronavirus", "lockdown"], "COVID-19 Pandemic Impact"),
    (["vaccine", "pfizer", "moderna", "booster"], "Vaccine Development"),
    (["gamestop", "gme", "squeeze", "reddit", "wallstreetbets"], "Meme Stock Squeeze"),
    (["robinhood", "trading halt", "retail"], "Retail Trading Disruption"),
    (["ai", "artificial intelligence", "chatgpt", "openai"], "AI Technology Boom"),
    (["nvidia", "chip", "semiconductor", "gpu"], "Semiconductor/AI Chips"),
    (["fed", "rate", "interest", "federal reserve", "monetary"], "Federal Reserve Policy"),
    (["inflation", "cpi", "consumer price", "prices"], "Inflation Concerns"),
    (["recession", "economy", "gdp", "economic"], "Recession/Economic Outlook"),
    (["oil", "energy", "opec", "crude", "gas"], "Energy/Oil Markets"),
    (["bank", "banking", "financial", "credit"], "Banking/Financial Sector"),
    (["tech", "technology", "apple", "microsoft", "google"], "Big Tech Performance"),
    (["earnings", "revenue", "profit", "quarterly"], "Corporate Earnings"),
    (["market", "stock", "dow", "nasdaq", "rally"], "Broad Market Movement"),
    (["crypto", "bitcoin", "blockchain"], "Cryptocurrency"),
    (["china", "trade war", "tariff", "geopolitical"], "Geopolitical/Trade"),
    (["tesla", "ev", "electric vehicle"], "EV/Tesla"),
    (["housing", "real estate", "mortgage"], "Real Estate/Housing"),
    (["supply chain", "shortage", "logistics"], "Supply Chain"),
    (["short", "hedge fund", "institutional"], "Institutional/Short Selling"),
]

# A word = a maximal run of Unicode letters, digits or underscore.
WORD_RE = r"[\p{L}\p{N}_]+"


def ascii_upper(text) -> Column:
    """Upper-case ASCII letters only (locale-free and identical in every
    engine; full Unicode upper-casing turns e.g. 'ß' into 'SS')."""
    return F.translate(col_(text), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def match_keywords(text, keywords: dict[str, list[str]], whole_word=False) -> Column:
    """L1: instruments whose keywords occur in the text (case-insensitive
    substring; ``whole_word`` requires word boundaries), in dict order."""
    low = F.lower(col_(text))
    items = []
    for ticker, kws in keywords.items():
        cond = None
        for kw in kws:
            k = kw.lower()
            c = low.rlike(r"(?<![\p{L}\p{N}_])" + _re_escape(k) + r"(?![\p{L}\p{N}_])") if whole_word \
                else low.contains(k)
            cond = c if cond is None else (cond | c)
        items.append(F.when(cond, F.lit(ticker)))
    return F.array_compact(F.array(*items))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def extract_symbols(text, allow=None, deny=None) -> Column:
    """L2: sorted distinct symbols: words of 2-5 capital letters A-Z (a
    leading '$' is allowed), kept when in ``allow`` and not in ``deny``."""
    words = F.regexp_extract_all(col_(text), F.lit(WORD_RE), 0)
    cands = F.filter(words, lambda w: w.rlike("^[A-Z]{2,5}$"))
    allow = SYMBOL_WHITELIST if allow is None else allow
    deny = SYMBOL_STOPWORDS if deny is None else deny
    keep = F.filter(cands, lambda w: F.array_contains(F.array(*[F.lit(a) for a in allow]), w)
                    & ~F.array_contains(F.array(*[F.lit(d) for d in deny]), w))
    return F.array_sort(F.array_distinct(keep))


def candidate_symbols(text) -> Column:
    """Words of 2-5 capital letters (before any whitelist)."""
    words = F.regexp_extract_all(col_(text), F.lit(WORD_RE), 0)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z]{2,5}$"))))


def lexicon_sentiment(text, neg=None, pos=None) -> dict[str, Column]:
    """Counts of lexicon words present (substring, lower-case) and a
    score +-(0.5 + 0.1 n) clamped to [-1, 1]; label by the larger count."""
    low = F.lower(col_(text))
    neg = NEGATIVE_WORDS if neg is None else neg
    pos = POSITIVE_WORDS if pos is None else pos
    nc = sum(low.contains(w).cast("int") for w in neg)
    pc = sum(low.contains(w).cast("int") for w in pos)
    score = (F.when(nc > pc, F.greatest(F.lit(-0.5) - nc * F.lit(0.1), F.lit(-1.0)))
             .when(pc > nc, F.least(F.lit(0.5) + pc * F.lit(0.1), F.lit(1.0)))
             .otherwise(F.lit(0.0)))
    label = F.when(nc > pc, "negative").when(pc > nc, "positive").otherwise("neutral")
    return {"neg_count": nc, "pos_count": pc, "score": score, "label": label}


def sentiment_label(score, band=0.1) -> Column:
    """Label by +-band."""
    s = col_(score)
    return F.when(s > band, "positive").when(s < -band, "negative").otherwise("neutral")


def topic_label(topic_id, keywords) -> Column:
    """First matching rule over the space-joined lower-case keywords,
    else the first three keywords, title-cased, joined by ' / '."""
    kw = F.transform(col_(keywords), lambda x: F.lower(x))
    s = F.array_join(F.slice(kw, 1, 10), " ")
    e = None
    for words, label in TOPIC_RULES:
        cond = None
        for w in words:
            c = s.contains(w)
            cond = c if cond is None else (cond | c)
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    fallback = F.initcap(F.array_join(F.slice(kw, 1, 3), " / "))
    return (F.when(col_(topic_id) == -1, F.lit("Uncategorized"))
            .when(F.size(col_(keywords)) == 0, F.concat(F.lit("Topic_"), col_(topic_id).cast("string")))
            .otherwise(e.otherwise(fallback)))


def html_to_text(html, max_chars: int | None = None) -> Column:
    """Page text. Drops comments and script/style/nav/footer/header/
    aside elements, prefers the first ``<article>``, else joins all ``<p>``;
    strips tags, unescapes basic entities, collapses whitespace."""
    h = col_(html)
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    art = F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    paras = F.array_join(F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), 1), " ")
    body = F.when(art != "", art).otherwise(paras)
    body = F.regexp_replace(body, r"<[^>]*>", " ")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                    ("&amp;", "&")):
        body = F.replace(body, F.lit(ent), F.lit(ch))
    body = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.substring(body, 1, max_chars) if max_chars else body


def parse_json_reply(text, schema) -> Column:
    """Strip code fences, take the outer JSON object, parse it."""
    t = F.regexp_replace(col_(text), r"^\s*```(?:json)?\s*", "")
    t = F.regexp_replace(t, r"\s*```\s*$", "")
    obj = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.from_json(obj, schema)


# What a trade, a symbol and a date look like in a note.
TRADE_LINE = r"(?i)\b(BUY|SELL|SHORT|LONG|CALL|PUT)\b\s+\$?([A-Z]{1,5})\b"
DOLLAR_SYM = r"\$([A-Z]{1,5})\b"
NOTE_DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
# Words skipped when a note has no structured trade.
NOTE_STOPWORDS = ["BUY", "SELL", "THE", "AND", "FOR", "WAS", "NOT", "BUT", "HAS", "HAD", "ARE", "HIS",
                  "HER", "CAN"]


def parse_trade_notes(df: DataFrame, text="text", id_col="note_id", fallback_n: int | None = None) -> DataFrame:
    """Free-text trade notes -> one row per trade.

    Non-blank trimmed lines are exploded with their position. A trade starts
    at a line "<action> [$]SYM" (action BUY/SELL/SHORT/LONG/CALL/PUT, any
    case) or, only before any trade has started, at a line with "$SYM"
    (action BUY). Following lines are appended to the trade's notes. A
    running ``sum(start)`` numbers the trades and a ``groupBy`` folds each
    back. Notes without any trade fall back to their distinct 2-5 letter
    capital words in order of appearance (the first ``fallback_n`` if given).
    """
    from pyspark.sql import Window
    lines = df.select(id_col, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    is_trade = F.col("line").rlike(TRADE_LINE)
    is_dollar = F.col("line").rlike(DOLLAR_SYM)
    w_prev = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"is_trade": is_trade, "is_dollar": is_dollar})
    lines = lines.withColumn("__seen", F.coalesce(F.max((F.col("is_trade") | F.col("is_dollar")).cast("int"))
                                                  .over(w_prev), F.lit(0)))
    start = F.col("is_trade") | (F.col("is_dollar") & (F.col("__seen") == 0))
    lines = lines.withColumn("start", start.cast("int"))
    w_run = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("trade_no", F.sum("start").over(w_run)).filter(F.col("trade_no") > 0)
    first = F.when(F.col("start") == 1, F.col("pos"))
    sym = F.when(F.col("is_trade"), F.upper(F.regexp_extract("line", TRADE_LINE, 2))) \
        .otherwise(F.regexp_extract("line", DOLLAR_SYM, 1))
    act = F.when(F.col("is_trade"), F.upper(F.regexp_extract("line", TRADE_LINE, 1))).otherwise(F.lit("BUY"))
    dt = F.nullif(F.regexp_extract("line", NOTE_DATE, 1), F.lit(""))
    trades = lines.groupBy(id_col, "trade_no").agg(
        F.min_by(sym, first).alias("ticker"), F.min_by(act, first).alias("action"),
        F.min_by(dt, first).alias("date"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]),
                     " ").alias("notes"))
    trades = trades.withColumn("trade_no", (F.col("trade_no") - 1).cast("int"))
    # Fallback for notes without a structured trade.
    words = F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Z]{2,5})\b"), 1)
    cand = F.filter(words, lambda x: ~F.array_contains(F.array(*[F.lit(s) for s in NOTE_STOPWORDS]), x))
    rest = df.join(trades.select(id_col).distinct(), id_col, "left_anti")
    fb = rest.select(id_col, F.posexplode(F.array_distinct(cand)).alias("trade_no", "ticker"))
    if fallback_n is not None:
        fb = fb.filter(F.col("trade_no") < fallback_n)
    fb = fb.select(id_col, F.col("trade_no").cast("int"), "ticker", F.lit("BUY").alias("action"),
                   F.lit(None).cast("string").alias("date"),
                   F.concat(F.lit("Mentioned in notes: "), F.col("ticker")).alias("notes"))
    return trades.unionByName(fb)


# Ordered note keyword rules -> pattern tag.
PATTERN_RULES = [
    (["oversold", "rsi"], "Oversold Entry"),
    (["breakout", "broke out"], "Breakout"),
    (["earnings", "report"], "Earnings Play"),
    (["dip", "drawdown", "crash"], "Dip Buy"),
    (["momentum", "trend"], "Momentum"),
    (["support", "resistance"], "Technical Level"),
    (["volume", "spike"], "Volume Signal"),
    (["news", "catalyst"], "News Catalyst"),
]
# Words that mark a win or a loss.
WIN_WORDS = ["profit", "gain", "won", "+"]
LOSS_WORDS = ["loss", "lost", "stop", "-"]


def tag_patterns(notes) -> dict[str, Column]:
    """Pattern tags (``Discretionary`` when none), entry reason and
    outcome (win / loss / open) from note keywords."""
    low = F.lower(col_(notes))

    def any_of(ws):
        c = None
        for w in ws:
            c = low.contains(w) if c is None else (c | low.contains(w))
        return c

    tags = F.array_compact(F.array(*[F.when(any_of(ws), F.lit(t)) for ws, t in PATTERN_RULES]))
    tags = F.when(F.size(tags) == 0, F.array(F.lit("Discretionary"))).otherwise(tags)
    outcome = F.when(any_of(WIN_WORDS), "win").when(any_of(LOSS_WORDS), "loss").otherwise("open")
    return {"patterns": tags, "reason_for_entry": tags[0], "outcome": outcome}


def parse_ts(col, formats=("yyyyMMdd'T'HHmmss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """L4: timestamp from text, trying each format in turn; else null."""
    return F.coalesce(*[F.try_to_timestamp(col_(col), F.lit(f)) for f in formats])


def filter_min_text(df, col, least=10):
    """Rows whose trimmed text has more than ``least`` characters (null
    texts go)."""
    return df.filter(F.col(col).isNotNull() & (F.length(F.trim(F.col(col))) > least))
