"""URL filter against a plain Python version of rules and models."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kairos.llm import urlfilter as U

SCHEMA = "page_id long, url string, host string, loc string, verdict string"


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    return host, rest[:min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]


def brute_text(url):
    """What the models read: the whole url behind the scheme, host lower-cased."""
    if url is None or "://" not in url:
        return url or ""
    host, _ = brute_split(url)
    return host + url.split("://", 1)[1][len(host):]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


class Brute:
    def __init__(self, texts):
        self.n, self.followers = Counter(), defaultdict(set)
        for t in texts:
            for w in grams(t):
                for k in range(U.ORDER + 1):
                    self.n[w[-k - 1:]] += 1
                    self.followers[k, w[len(w) - k - 1:-1]].add(w[-1])
        self.total = Counter()
        for g, c in self.n.items():
            self.total[len(g) - 1, g[:-1]] += c

    def p(self, gram, seen):
        """Seen grams use their counts; an unseen one falls to the shorter context."""
        if not gram:
            return 1 / U.ALPHABET
        k = len(gram) - 1
        n, t = self.total[k, gram[:-1]], len(self.followers[k, gram[:-1]])
        low = self.p(gram[1:], seen) if k else 1 / U.ALPHABET
        return (self.n[gram] + t * low) / (n + t) if n else low


def grams(t):
    s = U.BEGIN * U.ORDER + t + U.END
    return [s[i:i + U.ORDER + 1] for i in range(len(s) - U.ORDER)]


def check(spark, rows, got, evens):
    parts = {u: brute_split(u) for _, u in rows}
    train = {"allow": [], "block": []}
    for _, u in rows:
        h, p = parts[u]
        v = brute_rule(h, p)[1]
        if v and evens[h, p]:
            train[v].append(brute_text(u))
    a, r = Brute(train["allow"]), Brute(train["block"])
    score = {u: round(sum(math.log(a.p(w, None) / r.p(w, None)) for w in grams(brute_text(u))) / len(grams(brute_text(u))), 6) for u in parts}
    by = sorted((x["page_id"] if x["page_id"] is not None else -1, x["host"], x["path"], x["rule"] or "", round(x["score"], 6)) for x in got)
    want = sorted((i if i is not None else -1, *parts[u], brute_rule(*parts[u])[0] or "", score[u]) for i, u in rows)
    assert len(by) == len(want)
    for x, y in zip(by, want):
        assert x[:4] == y[:4] and abs(x[4] - y[4]) < 2e-6
    for x in got:
        v = brute_rule(x["host"], x["path"])[1]
        assert v is None or x["verdict"] == v
    free = [(x["score"], x["verdict"]) for x in got if x["rule"] is None]
    low = [s for s, v in free if v == "allow"]
    assert all(s < min(low, default=math.inf) for s, v in free if v == "block")


def evens_of(spark, parts):
    df = spark.createDataFrame(sorted(set(parts)), "host string, path string")
    return {(r["host"], r["path"]): r["e"] for r in df.select("host", "path", (F.pmod(F.xxhash64("host", "path"), F.lit(2)) == 0).alias("e")).collect()}


def test_small_table(spark, monkeypatch):
    urls = ["http://a.net/x", "https://WWW.Example.NET/en/1?q#f", "http://example.net/en", "ftp://b.example.com/de/9#x", "http://example.com/dex",
            "http://k.org/fr/1", "http://org/fr/", "http://org/en/", "http://notnet/x", "no scheme", None, "", "://", "http://", "http://é.net/ü漢",
            "http://x.net", "http://y.net?a=/", "http://s.example.com://de/", "http://long.org/" + "ab/" * 3000, "x://example.com/de/é"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.net/x"), (3, "http://shop.example.com/en/5"), (3, "http://shop.example.com/en/5")]
    rows += [(100 + i, f"http://h{i}.example.{'net' if i % 2 else 'org'}/{'fr' if i % 2 == 0 else 'es'}/{i}.html") for i in range(60)]
    df = spark.createDataFrame([(i, u, "c", "c", "c") for i, u in rows], SCHEMA).repartition(3)
    evens = evens_of(spark, [brute_split(u) for _, u in rows])
    check(spark, rows, U.judge(df).collect(), evens)
    monkeypatch.setattr(U, "SMALL", 10)  # the salted join
    check(spark, rows, U.judge(df).collect(), evens)


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://example.com/en/"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in U.judge(df).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert U.judge(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_SMALL
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url").collect()]
    got = catalog.q_urls(spark, SF_SMALL).collect()
    check(spark, rows, got, evens_of(spark, [brute_split(u) for _, u in rows]))
