"""Latest-row features, simple score and sector reports (E37, F13, P12, H5,
H7, H8, K5, K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div


def _rd(c, d):
    s = float(10 ** d)
    return F.round(c * F.lit(s)) / F.lit(s)


def latest_features(bars: DataFrame, k="ticker", t="dt", min_rows=50) -> DataFrame:
    """E37 + F13: features of each instrument's most recent history and a
    five-tier score: 20-row return, 20-row RMS return, max drawdown inside
    the last 60 rows (running peak from the slice start), last-day volume
    spike vs the previous 20, population skew of the last 60 returns."""
    w = Window.partitionBy(k).orderBy(t)
    x = bars.withColumns({"__r": div(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)),
                          "__rd": F.row_number().over(Window.partitionBy(k).orderBy(F.col(t).desc()))})
    s60 = x.filter(F.col("__rd") <= 60)
    peak = F.max("close").over(Window.partitionBy(k).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    dd = s60.withColumn("__dd", F.coalesce(div(peak - F.col("close"), peak), F.lit(0.0))) \
        .groupBy(k).agg(F.greatest(F.max("__dd"), F.lit(0.0)).alias("max_drawdown"))
    rd = F.col("__rd")
    agg = x.groupBy(k).agg(
        F.count(F.lit(1)).alias("history_len"),
        F.max(F.when(rd == 1, F.col("close"))).alias("last"),
        F.max(F.when(rd == 21, F.col("close"))).alias("__c20"),
        F.min_by("close", t).alias("__c0"),
        F.sqrt(F.avg(F.when(rd <= 20, F.col("__r") * F.col("__r")))).alias("__vol"),
        F.max(F.when(rd == 1, F.col("volume"))).alias("__vlast"),
        F.sum(F.when((rd >= 2) & (rd <= 21), F.col("volume"))).alias("__v20"),
        F.skewness(F.when(rd <= 60, F.col("__r"))).alias("__sk"),
        F.count(F.when(rd <= 60, F.col("__r"))).alias("__nsk"))
    n = F.col("history_len")
    prev = F.when(n > 20, F.col("__c20")).otherwise(F.col("__c0"))
    ret20 = F.coalesce(div(F.col("last") - prev, prev), F.lit(0.0))
    vol = F.when(n >= 20, F.coalesce(F.col("__vol"), F.lit(0.0))).otherwise(F.lit(0.0))
    avgv = F.when(F.col("__v20") > 0, F.col("__v20") / 20.0).otherwise(F.lit(1.0))
    spike = F.when((n >= 20) & (F.col("__vlast") > 0), F.col("__vlast") / avgv).otherwise(F.lit(1.0))
    skew = F.when((n >= 30) & (F.col("__nsk") > 2), F.coalesce(F.col("__sk"), F.lit(0.0))).otherwise(F.lit(0.0))
    out = agg.join(dd, k).filter(n >= min_rows).select(
        k, n.alias("history_len"), F.col("last").alias("price"), ret20.alias("ret_20d"), vol.alias("volatility"),
        "max_drawdown", spike.alias("vol_spike"), skew.alias("skewness"))
    s = (F.when(F.col("max_drawdown") > 0.15, 1).otherwise(0)
         + F.when((F.col("max_drawdown") > 0.10) & (F.col("vol_spike") > 2.0), 1).otherwise(0)
         + F.when(F.col("skewness") > 0.5, 1).otherwise(0)
         + F.when((F.col("ret_20d") < -0.10) & (F.col("volatility") < 0.05), 1).otherwise(0))
    out = out.withColumn("__s", s)
    out = out.withColumn("simple_score", F.col("__s") + F.when((F.col("__s") >= 3) & (F.col("skewness") > 0.8), 1)
                         .otherwise(0)).drop("__s")
    out = out.withColumn("top_tier", F.col("simple_score") >= 4)
    return out.withColumns({"price": _rd(F.col("price"), 2), "ret_20d": _rd(F.col("ret_20d"), 4),
                            "volatility": _rd(F.col("volatility"), 4), "max_drawdown": _rd(F.col("max_drawdown"), 4),
                            "vol_spike": _rd(F.col("vol_spike"), 2), "skewness": _rd(F.col("skewness"), 3)})


def sector_reports(latest: DataFrame) -> DataFrame:
    """P12 + H2: per sector: mean score/drawdown/forward median/vol and RSI,
    a sentiment and a risk level, and the top-3 picks (score desc, drawdown
    asc, ticker) with action and conviction. One row per (sector, pick)."""
    ws = Window.partitionBy("sector")
    x = latest.withColumns({
        "avg_gs": F.avg("signal_score").over(ws), "avg_dd": F.avg("drawdown_pct").over(ws),
        "avg_fwd": F.avg(F.coalesce("fwd_60d_median", F.lit(0.0))).over(ws),
        "avg_vol": F.avg("vol_percentile").over(ws),
        "avg_rsi": F.coalesce(F.avg("rsi_14").over(ws), F.lit(50.0))})
    sent = (F.when(((F.col("avg_rsi") > 55) & (F.col("avg_fwd") > 0.01)) | (F.col("avg_gs") > 3), "bullish")
            .when(((F.col("avg_rsi") < 40) & (F.col("avg_dd") < -0.12)) | (F.col("avg_fwd") < -0.02), "bearish")
            .otherwise("neutral"))
    risk = F.when(F.col("avg_vol") > 0.7, "high").when(F.col("avg_vol") > 0.4, "medium").otherwise("low")
    x = x.withColumns({"sector_sentiment": sent, "risk_level": risk})
    r = F.row_number().over(ws.orderBy(F.col("signal_score").desc(), F.col("drawdown_pct").asc(), F.col("ticker")))
    x = x.withColumn("pick", r).filter(F.col("pick") <= 3)
    med = F.coalesce(F.col("fwd_60d_median"), F.lit(0.0))
    act = (F.when((F.col("drawdown_pct") < -0.1) & (F.col("signal_score") >= 2), "BUY")
           .when(F.col("avg_rsi") > 70, "PUT").when(med > 0.03, "CALL").when(med < -0.02, "SHORT")
           .otherwise("BUY"))
    conv = F.least(F.lit(100), F.round(F.lit(30.0) + F.col("signal_score") * 12.0
                                       + F.abs("drawdown_pct") * 50.0).cast("int"))
    return x.select("sector", "sector_sentiment", "risk_level", "pick", "ticker", act.alias("action"),
                    conv.alias("conviction"))


def select_universe(latest: DataFrame, n: int, min_history=200, size="avg_volume") -> DataFrame:
    """H5: top ``n`` instruments by size among those with enough history."""
    x = latest.filter(F.col("history_len") >= min_history)
    # TakeOrdered: each task keeps its own top n; no single-partition window.
    return x.orderBy(F.col(size).desc(), F.col("ticker")).limit(n)


def leaderboard(trades: DataFrame, agent="agent_id", t="ts", profit="profit", last_n=8) -> DataFrame:
    """H7: agents ranked by total profit with win rate and their last
    ``last_n`` trades (newest first)."""
    from .ranking import global_rank, top_k_per_group
    recent = top_k_per_group(trades, agent, [F.col(t).desc(), F.col("trade_id").desc()], last_n, out="__r") \
        .groupBy(agent).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "trade_id", profit))),
                                        lambda s: s["trade_id"]).alias("last_trades"))
    tot = trades.groupBy(agent).agg(F.sum(profit).alias("total_profit"), F.count(F.lit(1)).alias("total_trades"),
                                    (F.count_if(F.col(profit) >= 0) / F.count(F.lit(1))).alias("win_rate"))
    out = tot.join(recent, agent)
    return global_rank(out, [F.col("total_profit").desc(), F.col(agent)], name="leaderboard")


def event_feed(*parts: DataFrame) -> DataFrame:
    """K5/K6: one feed from several projections (``unionByName``)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fund_allocations(latest: DataFrame) -> DataFrame:
    """H3: three strategy books over the latest snapshot.
    momentum: RSI > 55 and MACD histogram > 0, top 8 by RSI, equal weight,
    CALL when RSI > 70 else BUY; value: drawdown < -8 % and score >= 1, 8
    deepest, equal weight, BUY; contrarian: 4 highest RSI > 72 SHORT at 0.12
    and 4 lowest RSI < 32 BUY at 0.13. Ties by ticker."""
    x = latest.select("ticker", "rsi_14", "macd_histogram", "drawdown_pct", "signal_score")

    def book(df, fund, order, n, weight=None, action=None):
        r = F.row_number().over(Window.orderBy(*order))
        d = df.withColumn("__r", r).filter(F.col("__r") <= n)
        w = F.lit(weight) if weight is not None else F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy())
        return d.select(F.lit(fund).alias("fund"), "ticker", w.alias("weight"), action.alias("action"))

    mom = book(x.filter((F.col("rsi_14") > 55) & (F.col("macd_histogram") > 0)), "momentum",
               [F.col("rsi_14").desc(), F.col("ticker")], 8,
               action=F.when(F.col("rsi_14") > 70, "CALL").otherwise("BUY"))
    val = book(x.filter((F.col("drawdown_pct") < -0.08) & (F.col("signal_score") >= 1)), "value",
               [F.col("drawdown_pct"), F.col("ticker")], 8, action=F.lit("BUY"))
    sh = book(x.filter(F.col("rsi_14") > 72), "contrarian", [F.col("rsi_14").desc(), F.col("ticker")], 4, 0.12,
              F.lit("SHORT"))
    lg = book(x.filter(F.col("rsi_14") < 32), "contrarian", [F.col("rsi_14"), F.col("ticker")], 4, 0.13,
              F.lit("BUY"))
    return mom.unionByName(val).unionByName(sh).unionByName(lg)


def fund_profit(alloc: DataFrame, latest: DataFrame) -> DataFrame:
    """Per fund: sum(weight * +-median forward return, x1.5 for CALL) x 10000."""
    j = alloc.join(latest.select("ticker", F.coalesce("fwd_60d_median", F.lit(0.0)).alias("__m")), "ticker")
    ret = F.when(F.col("action").isin("SHORT", "PUT"), -F.col("__m")).otherwise(F.col("__m"))
    ret = F.when(F.col("action") == "CALL", ret * 1.5).otherwise(ret)
    return j.groupBy("fund").agg((F.sum(ret * F.col("weight")) * 10000.0).alias("profit"),
                                 F.count(F.lit(1)).alias("positions"))


def risk_review(alloc: DataFrame, latest: DataFrame, max_pos=0.25, deep_dd=-0.20, max_short=0.40,
                hot_vol=0.4, hot_weight=0.15) -> DataFrame:
    """Risk rules as predicates, then reweight and renormalise per fund:
    positions above 25 % capped; shorts in drawdown below -20 % removed;
    volatile (> 0.4) positions capped at 15 %; total short weight scaled
    down to 40 %."""
    j = alloc.join(latest.select("ticker", "drawdown_pct", "realized_vol_20d"), "ticker", "left")
    is_short = F.col("action").isin("SHORT", "PUT")
    j = j.withColumns({
        "flag_oversized": F.col("weight") > max_pos,
        "flag_short_in_drawdown": is_short & (F.col("drawdown_pct") < deep_dd),
        "flag_hot": (F.col("realized_vol_20d") > hot_vol) & (F.col("weight") > hot_weight)})
    w = F.least(F.col("weight"), F.lit(max_pos))
    w = F.when(F.col("flag_short_in_drawdown"), F.lit(0.0)).otherwise(w)
    w = F.when(F.col("flag_hot"), F.least(w, F.lit(hot_weight))).otherwise(w)
    j = j.withColumn("__w", w)
    fund = Window.partitionBy("fund")
    short_tot = F.sum(F.when(is_short, F.col("__w")).otherwise(0.0)).over(fund)
    j = j.withColumn("__w", F.when(is_short & (short_tot > max_short), F.col("__w") * max_short / short_tot)
                     .otherwise(F.col("__w")))
    tot = F.sum("__w").over(fund)
    return j.withColumn("adjusted_weight", F.when(tot > 0, F.col("__w") / tot).otherwise(F.lit(0.0))).drop("__w")


def apportion(latest: DataFrame, total: int) -> DataFrame:
    """Spread ``total`` units over instruments: raw = floor(10 + 20 s^2),
    scaled and rounded (min 1); a surplus goes to the first instrument, a
    deficit is taken from the last ones (each keeps >= 1). Windows over the
    snapshot (one row per instrument)."""
    allw = Window.partitionBy()
    o = Window.orderBy("ticker")
    x = latest.select("ticker", "signal_score").withColumn(
        "raw", F.floor(F.lit(10.0) + F.col("signal_score") * F.col("signal_score") * 20.0))
    x = x.withColumn("scale", F.lit(float(total)) / F.greatest(F.sum("raw").over(allw), F.lit(1)))
    x = x.withColumn("a", F.greatest(F.lit(1), F.round(F.col("raw") * F.col("scale")).cast("long")))
    x = x.withColumns({"__diff": F.lit(total) - F.sum("a").over(allw), "__i": F.row_number().over(o)})
    cap_after = F.coalesce(F.sum(F.col("a") - 1).over(o.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    remove = F.least(F.col("a") - 1, F.greatest(F.lit(0), -F.col("__diff") - cap_after))
    units = (F.when(F.col("__diff") > 0, F.when(F.col("__i") == 1, F.col("a") + F.col("__diff")).otherwise(F.col("a")))
             .otherwise(F.col("a") - remove))
    return x.select("ticker", "signal_score", "raw", units.cast("long").alias("units"))


def lane_counts(latest: DataFrame) -> DataFrame:
    """Crowd per instrument: total = max(1, round(5 + 8 s + 20 |dd|));
    a quarter at the door; the rest split by direction bias, rest to short."""
    base = F.lit(5.0) + F.col("signal_score") * 8.0 + F.abs(F.coalesce("drawdown_pct", F.lit(0.0))) * 20.0
    x = latest.withColumn("total", F.greatest(F.lit(1), F.round(base).cast("long")))
    x = x.withColumn("door", F.round(F.col("total") * 0.25).cast("long"))
    x = x.withColumn("inside", F.col("total") - F.col("door"))
    x = x.withColumns({k: F.round(F.col("inside") * F.col(f"{k}_pct")).cast("long") for k in ("buy", "call", "put")})
    x = x.withColumn("short", F.greatest(F.lit(0), F.col("inside") - F.col("buy") - F.col("call") - F.col("put")))
    return x.select("ticker", "total", "door", "inside", "buy", "call", "put", "short")


def journal_stats(trades: DataFrame) -> DataFrame:
    """Trade-journal analysis: per pattern (exploded) trades, wins,
    win rate and total profit; plus an overall row (pattern = '__all__')."""
    t = trades.withColumn("__win", (F.col("outcome") == "win").cast("int"))
    per = t.select("*", F.explode("patterns").alias("pattern")).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("__win").alias("wins"),
        F.sum(F.coalesce("profit", F.lit(0.0))).alias("total_profit"))
    allr = t.agg(F.lit("__all__").alias("pattern"), F.count(F.lit(1)).alias("trades"), F.sum("__win").alias("wins"),
                 F.sum(F.coalesce("profit", F.lit(0.0))).alias("total_profit"))
    out = per.unionByName(allr)
    return out.withColumn("win_rate", F.col("wins") / F.col("trades"))


def pattern_graph(trades: DataFrame) -> DataFrame:
    """Weighted edges ticker -> pattern (trade counts) and pattern ->
    outcome (share of the pattern's trades)."""
    ex = trades.select("ticker", "outcome", F.explode("patterns").alias("pattern"))
    tp = ex.groupBy(F.col("ticker").alias("src"), F.col("pattern").alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")).withColumn("kind", F.lit("ticker_pattern"))
    po = ex.groupBy(F.col("pattern").alias("src"), F.col("outcome").alias("dst")).agg(F.count(F.lit(1)).alias("__n"))
    po = po.withColumn("weight", F.col("__n") / F.sum("__n").over(Window.partitionBy("src"))) \
        .drop("__n").withColumn("kind", F.lit("pattern_outcome"))
    return tp.unionByName(po)


def project_forward(latest: DataFrame, days: int = 90) -> DataFrame:
    """F16 (noise-free part): project bias, score, drawdown and tickets
    ``days`` ahead from the forward median and skew."""
    p = min(max(1, days) / 365.0, 1.0)
    med = F.coalesce(F.col("fwd_60d_median"), F.lit(0.0))
    skew = F.coalesce(F.col("fwd_60d_skew"), F.lit(0.0))
    bull = F.least(F.greatest(F.lit(0.5) + med * F.lit(p) * 3.0, F.lit(0.1)), F.lit(0.9))
    x = latest.withColumn("__b", bull)
    parts = {"buy_pct": F.col("__b") * 0.55, "call_pct": F.col("__b") * 0.45,
             "put_pct": (F.lit(1.0) - F.col("__b")) * 0.5, "short_pct": (F.lit(1.0) - F.col("__b")) * 0.5}
    x = x.withColumns({f"__{k}": v for k, v in parts.items()})
    tot = F.col("__buy_pct") + F.col("__call_pct") + F.col("__put_pct") + F.col("__short_pct")
    shift = skew * F.lit(p) * 0.5 + med * F.lit(p) * 2.0
    gs = F.least(F.greatest(F.floor(F.col("signal_score") + shift + 0.5), F.lit(0)), F.lit(5)).cast("int")
    x = x.withColumns({**{k: F.greatest(F.lit(0.05), F.col(f"__{k}") / tot) for k in parts},
                       "projected_score": gs,
                       "projected_drawdown": F.least(F.greatest(F.col("drawdown_pct") + med * F.lit(p), F.lit(-0.5)),
                                                     F.lit(0.0))})
    x = x.withColumns({f"projected_signal_{i}": F.col("projected_score") >= i for i in range(1, 6)})
    return x.select("ticker", *parts.keys(), "projected_score", "projected_drawdown",
                    *[f"projected_signal_{i}" for i in range(1, 6)])


def payload_checks(snapshot_docs: DataFrame, graph_docs: DataFrame, news: DataFrame | None = None, min_stocks=400, min_edges=500,
                   min_sectors=8) -> DataFrame:
    """M5: rules over the emitted documents (parsed back from JSON): stocks,
    edges, missing names, prices, score range, top-tier share, sectors, and
    the share of stocks with news (``news``: ticker rows)."""
    from .quality import run_checks
    st = snapshot_docs.select(F.explode(F.from_json(
        "json", "struct<stocks: array<struct<ticker: string, sector: string, close: double, signal_score: int, top_tier: boolean>>>").stocks).alias("s"))
    st = st.select("s.*")
    if news is not None:
        st = st.join(news.select("ticker").distinct().withColumn("covered", F.lit(True)), "ticker", "left")
    else:
        st = st.withColumn("covered", F.lit(False))
    n = F.count(F.lit(1))
    share = lambda c: F.coalesce(F.count_if(c) * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0))
    stocks = run_checks(st, "payload", [
        ("stock_count", n, f">={min_stocks}", lambda v: v >= min_stocks),
        ("null_tickers", F.count_if(F.col("ticker").isNull()), "0", lambda v: v == 0),
        ("null_sectors", F.count_if(F.col("sector").isNull()), "0", lambda v: v == 0),
        ("non_positive_price", F.count_if(~(F.col("close") > 0)), "0", lambda v: v == 0),
        ("score_range", F.count_if((F.col("signal_score") < 0) | (F.col("signal_score") > 5)), "0", lambda v: v == 0),
        ("top_tier_pct", share(F.col("top_tier")), "[0,10)", lambda v: (v >= 0) & (v < 10)),
        ("sector_count", F.count_distinct("sector"), f">={min_sectors}", lambda v: v >= min_sectors),
        ("news_coverage_pct", share(F.col("covered")), ">50", lambda v: v > 50)])
    ed = graph_docs.select(F.explode(F.from_json(
        "json", "struct<edges: array<struct<target: string, weight: double>>>").edges).alias("e"))
    edges = run_checks(ed, "payload", [
        ("edge_count", n / 2, f">={min_edges}", lambda v: v >= min_edges),
        ("edge_weight_out_of_range", F.count_if((F.col("e.weight") < -1) | (F.col("e.weight") > 1)), "0", lambda v: v == 0)])
    return stocks.unionByName(edges)
