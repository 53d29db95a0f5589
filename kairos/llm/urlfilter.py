"""URL filter: host and path rules, then a character language-model ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: (host, path prefix, verdict): the host and all its subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 3  # characters of context
ALPHABET = 256  # the zeroth order falls back on 1 / ALPHABET
BEGIN, END = "\x02", "\x03"
SMALL = 300_000  # rows of a table that may be broadcast


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def model_text(url: Column, host: Column) -> Column:
    """What the models read: host, path, query and fragment; the url as it is
    where ``://`` is missing."""
    rest = F.regexp_replace(F.expr("substring(url, locate('://', url) + 3)"), r"^[^/?#]*", "")
    return F.coalesce(F.when(F.locate("://", url) > 0, F.concat(host, rest)).otherwise(url), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last one tested is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def characters(text: Column) -> Column:
    """The text's characters with ORDER begin marks and one end mark."""
    return F.split(F.concat(F.lit(BEGIN * ORDER), text, F.lit(END)), "")


def windows(chars: Column) -> Column:
    """For each character and the end mark: ORDER characters before it and
    itself. Taken by index: ``slice`` copies the whole array every time."""
    return F.transform(F.sequence(F.lit(0), F.size(chars) - (ORDER + 1)), lambda i: F.concat(*[F.get(chars, i + k) for k in range(ORDER + 1)]))


def _grams(win: DataFrame) -> DataFrame:
    """(k, gram, a, r): k characters of context, the character, and how often
    accepted and rejected urls hold it; summed from the window counts."""
    cut = [F.struct(F.lit(k).alias("k"), F.substring("w", ORDER + 1 - k, k + 1).alias("gram")) for k in range(ORDER + 1)]
    return win.select("a", "r", F.explode(F.array(*cut)).alias("g")).groupBy("g.k", "g.gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def model(train: DataFrame) -> DataFrame:
    """(k, gram, pa, pr): probability of each seen gram's last character after
    its context, for accepted and rejected urls, with Witten-Bell smoothing
    towards the shorter context. ``train`` has window counts (w, a, r)."""
    grams = stage(_grams(train), "grams")
    ctx = grams.groupBy("k", F.expr("substring(gram, 1, k)").alias("ctx")).agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
    ctx = stage(ctx, "contexts")
    out = None
    for k in range(ORDER + 1):
        rows = grams.filter(F.col("k") == k).withColumn("ctx", F.expr("substring(gram, 1, k)")).join(
            ctx.filter(F.col("k") == k).drop("k"), "ctx")
        if k:
            low = out.select(F.col("gram").alias("tail"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
            rows = rows.join(low, F.expr("substring(gram, 2)") == F.col("tail"))
        else:
            rows = rows.withColumn("la", F.lit(1.0 / ALPHABET)).withColumn("lr", F.lit(1.0 / ALPHABET))
        smooth = lambda n, t, low, of: F.when(of + t > 0, (n + t * low) / (of + t)).otherwise(low)
        out = stage(rows.select("k", "gram", smooth(F.col("a"), F.col("ta"), F.col("la"), F.col("na")).alias("pa"),
                                smooth(F.col("r"), F.col("tr"), F.col("lr"), F.col("nr")).alias("pr")), f"order{k}")
        whole = out if k == 0 else whole.unionByName(out)
    back = lambda t, n: F.when(n + t > 0, t / (n + t)).otherwise(F.lit(1.0))
    falls = ctx.select("k", "ctx", F.log(back(F.col("ta"), F.col("na")) / back(F.col("tr"), F.col("nr"))).alias("fall"))
    return whole.select("k", "gram", F.log(F.col("pa") / F.col("pr")).alias("v")), falls


def window_values(wins: DataFrame, grams: DataFrame, falls: DataFrame) -> DataFrame:
    """(w, v): log-likelihood ratio of each window's last character: that of
    the longest seen gram, plus the falls from the longer seen contexts."""
    rows = wins.select("w")
    total = F.lit(0.0)
    for k in range(ORDER + 1):
        g = grams.filter(F.col("k") == k).select(F.col("gram").alias(f"g{k}"), F.col("v").alias(f"v{k}"))
        c = falls.filter(F.col("k") == k).select(F.col("ctx").alias(f"c{k}"), F.col("fall").alias(f"f{k}"))
        rows = rows.join(g, F.substring("w", ORDER + 1 - k, k + 1) == F.col(f"g{k}"), "left")
        rows = rows.join(c, F.substring("w", ORDER + 1 - k, k) == F.col(f"c{k}"), "left")
        total = F.coalesce(F.col(f"v{k}"), F.coalesce(F.col(f"f{k}"), F.lit(0.0)) + total)
    return rows.select("w", total.alias("v"))


def _summed(chars: DataFrame, values: DataFrame) -> DataFrame:
    """(loc, score): mean of the windows' values over each url."""
    if values.count() <= SMALL:
        rows = chars.join(F.broadcast(values), "w")
    else:  # frequent windows are dealt over 64 copies of the table's rows
        salted = values.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(63))))
        rows = chars.withColumn("s", F.pmod(F.xxhash64("loc"), F.lit(64)).cast("int")).join(salted, ["w", "s"])
    return rows.groupBy("loc").agg(F.round(F.avg("v"), 9).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score bound with the best mean of both classes' accuracies, from a
    histogram of (score, good) in steps of 0.01; urls at or above it pass."""
    bins = scored.groupBy(F.floor(F.greatest(F.least("score", F.lit(5.0)), F.lit(-5.0)) * 100).cast("int").alias("b")).agg(
        F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r")).collect()  # 1001 rows at most
    bins.sort(key=lambda x: x["b"])
    accepted, rejected = sum(x["a"] for x in bins), sum(x["r"] for x in bins)
    if not accepted or not rejected:
        return 0.0
    best, at, below_a, below_r = -1.0, 0, 0, 0
    for x in [*bins, {"b": bins[-1]["b"] + 1, "a": 0, "r": 0}]:
        good = (accepted - below_a) / accepted + below_r / rejected
        if good > best + 1e-12 or abs(good - best) <= 1e-12 and abs(x["b"]) < abs(at):
            best, at = good, x["b"]
        below_a, below_r = below_a + x["a"], below_r + x["r"]
    return at / 100


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    A rule decides where one fits. Urls allowed and blocked by rules train two
    variable-order models of the whole url (``model_text``); those with an
    even hash of host and path are counted, the others set the threshold. All
    urls get the mean log-likelihood ratio of their characters; without a rule
    they pass at or above the threshold. A null url or one without ``://`` has
    empty host and path; where no url was accepted or none rejected, urls
    without a rule pass. Repeated rows and null ids stay rows; an empty table gives an empty
    result; other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.monotonically_increasing_id().alias("loc"))
    host, path = split_url(F.col("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = stage(urls.select("page_id", "loc", "host", "path", model_text(F.col("url"), F.col("host")).alias("text"),
                             rule.alias("rule"), verdict.alias("ruled")), "urls")
    even = F.pmod(F.xxhash64("host", "path"), F.lit(2)) == 0
    # explode_outer: for explode the optimizer moves a filter on the array's
    # size, and so the cutting into characters, into every step of the array.
    chars = urls.select("loc", "ruled", even.alias("even"), characters(F.col("text")).alias("chars")).select(
        "loc", "ruled", "even", F.explode_outer(windows(F.col("chars"))).alias("w"))
    wins = stage(chars.groupBy("w").agg(F.count_if((F.col("ruled") == "allow") & F.col("even")).alias("a"),
                                        F.count_if((F.col("ruled") == "block") & F.col("even")).alias("r")), "windows")
    grams, falls = model(wins.filter("a + r > 0"))
    values = stage(window_values(wins, grams, falls), "window-values")
    scores = stage(_summed(chars.select("loc", "w"), values), "url-scores")
    seen = {r["ruled"] for r in urls.filter("ruled is not null").select("ruled").distinct().collect()}
    scored = urls.withColumn("even", even).join(scores, "loc", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    both = len(seen) == 2
    bound = threshold(scored.filter("ruled is not null and not even").select("score", (F.col("ruled") == "allow").alias("good"))) if both else 0.0
    passed = F.when(F.col("score") >= bound, "allow").otherwise("block") if both else F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", passed).alias("verdict"), "score")
