"""Decision engine: archetype x instrument scoring.

All random draws of the source are replaced by ``stable_uniform`` (md5 of
the row's identity), so a run is reproducible and has an exact SQL twin.
The grid (dates x archetypes x instruments) is built by exploding each
instrument row over the fixed archetype ids and an equi-join to the
100-row archetype table (broadcast, size fixed by the parameters); all
per-(date, archetype) steps are windows over at most one date's instruments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import stable_uniform

# Base archetypes (risk, greed, fear, news sensitivity,
# contrarian factor, buy/call/put/short probabilities, preferred sectors).
BASE_ARCHETYPES = [
    ("institutional_value", 0.35, 0.20, 0.15, 0.25, 0.40, 0.60, 0.15, 0.10, 0.15,
     "Financials,Consumer Staples,Utilities,Healthcare"),
    ("institutional_growth", 0.55, 0.50, 0.25, 0.45, -0.10, 0.55, 0.25, 0.10, 0.10,
     "Technology,Healthcare,Communication Services"),
    ("hedge_fund_macro", 0.70, 0.45, 0.20, 0.70, 0.25, 0.30, 0.25, 0.25, 0.20,
     "Energy,Financials,Materials,Industrials"),
    ("hedge_fund_quant", 0.60, 0.35, 0.10, 0.15, 0.55, 0.35, 0.20, 0.20, 0.25, "ALL"),
    ("retail_longterm", 0.30, 0.25, 0.35, 0.40, 0.15, 0.70, 0.10, 0.10, 0.10,
     "Technology,Consumer Discretionary,Consumer Staples"),
    ("retail_daytrader", 0.75, 0.70, 0.40, 0.65, -0.20, 0.35, 0.30, 0.15, 0.20,
     "Technology,Consumer Discretionary"),
    ("retail_wsb_degen", 0.95, 0.95, 0.05, 0.90, -0.40, 0.30, 0.50, 0.05, 0.15,
     "Consumer Discretionary,Technology,Communication Services"),
    ("algorithmic_hft", 0.50, 0.30, 0.05, 0.10, 0.00, 0.35, 0.15, 0.15, 0.35, "ALL"),
    ("contrarian", 0.65, 0.30, 0.10, 0.50, 0.85, 0.45, 0.20, 0.15, 0.20, "ALL"),
    ("momentum_chaser", 0.70, 0.80, 0.30, 0.55, -0.50, 0.40, 0.30, 0.10, 0.20,
     "Technology,Consumer Discretionary,Communication Services"),
]
VARIANTS = 10
JITTER = 0.15

# Regime modifiers (greed boost, fear reduction, buy bias, urgency base).
REGIME_MODIFIERS = [("Bull", 0.15, 0.10, 0.10, 0.3), ("Bear", -0.10, -0.15, -0.15, 0.6),
                    ("Neutral", 0.0, 0.0, 0.0, 0.4)]

BASE_SCHEMA = ("base_type string, risk double, greed double, fear double, news double, contr double, "
               "buy double, call double, put double, short double, sector_pref string")


def _r3(c):
    """Round to 3 digits as round(x*1000)/1000 (same double in every engine)."""
    return F.round(c * F.lit(1000.0)) / F.lit(1000.0)


def make_archetypes(spark: SparkSession) -> DataFrame:
    """10 base archetypes x 10 variants with +-15 % jitter (clipped) and
    jittered, renormalised action probabilities."""
    base = spark.createDataFrame(BASE_ARCHETYPES, BASE_SCHEMA)
    v = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant_index"))

    def jit(c, lo=0.0, hi=1.0):
        u = stable_uniform("base_type", "variant_index", F.lit(c))
        x = F.col(c)
        return _r3(F.least(F.greatest(x + (u * F.lit(2 * JITTER) - F.lit(JITTER)) * x, F.lit(lo)), F.lit(hi)))

    def pj(c):
        u = stable_uniform("base_type", "variant_index", F.lit(c + "_p"))
        return F.greatest(F.lit(0.01), F.col(c) + (u * F.lit(0.1) - F.lit(0.05)))

    v = v.withColumns({"risk_tolerance": jit("risk"), "greed_j": jit("greed"), "fear_j": jit("fear"),
                       "news_sensitivity": jit("news"), "contrarian_factor": jit("contr", -1.0, 1.0),
                       "b0": pj("buy"), "c0": pj("call"), "p0": pj("put"), "s0": pj("short")})
    tot = F.col("b0") + F.col("c0") + F.col("p0") + F.col("s0")
    v = v.withColumn("__t", tot)
    return v.select(
        F.concat("base_type", F.lit("_v"), F.lpad(F.col("variant_index").cast("string"), 2, "0")).alias("archetype_id"),
        "base_type", "variant_index", "risk_tolerance", F.col("greed_j").alias("greed"),
        F.col("fear_j").alias("fear"), "news_sensitivity", "contrarian_factor",
        _r3(F.col("b0") / F.col("__t")).alias("buy_prob"), _r3(F.col("c0") / F.col("__t")).alias("call_prob"),
        _r3(F.col("p0") / F.col("__t")).alias("put_prob"), _r3(F.col("s0") / F.col("__t")).alias("short_prob"),
        F.col("sector_pref").alias("sector_preference"))


def regime_modifiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIME_MODIFIERS, "regime_label string, greed_boost double, "
                                                   "fear_reduction double, buy_bias double, urgency_base double")


def _or(c, default):
    """The source's ``x or default``: null or 0 -> default."""
    return F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(default)).otherwise(F.col(c))


def score_grid(grid: DataFrame) -> DataFrame:
    """P2 + P3: regime-modulated greed/fear and the composite stock score."""
    g = grid.withColumns({
        "eff_greed": F.least(F.greatest(F.col("greed") + F.col("greed_boost"), F.lit(0.0)), F.lit(1.0)),
        "eff_fear": F.least(F.greatest(F.col("fear") - F.col("fear_reduction"), F.lit(0.0)), F.lit(1.0)),
        "__ret": _or("daily_return", 0.0), "__dd": _or("drawdown_pct", 0.0),
        "__gold": _or("signal_score", 0).cast("double"), "__vp": _or("volume_percentile", 0.5),
        "__rsi": _or("rsi_14", 50.0), "__z": _or("zscore_20d", 0.0), "__vol": _or("realized_vol_20d", 0.2)})
    c = F.col("contrarian_factor")
    s = F.when(F.col("__ret") > 0, F.col("eff_greed") * F.col("__ret") * 50.0) \
        .otherwise(F.col("eff_fear") * F.col("__ret") * 30.0)
    s = s + F.when(c > 0, c * F.abs("__dd") * 20.0).otherwise(c * F.abs("__dd") * 10.0)
    s = s + F.col("__gold") * 3.0 * F.col("eff_greed")
    s = s + (F.lit(1.0) - F.abs(c)) * F.col("__vp") * 5.0
    s = s - F.abs(c) * F.col("__vp") * 3.0
    s = s + F.when(F.col("__rsi") < 30, c * 5.0 - (F.lit(1.0) - c) * 3.0) \
        .when(F.col("__rsi") > 70, F.col("eff_greed") * 3.0 - c * 4.0).otherwise(F.lit(0.0))
    s = s + c * (-F.col("__z")) * 4.0
    s = s - (F.lit(1.0) - F.col("risk_tolerance")) * F.col("__vol") * 15.0
    # News: sensitivity times sentiment; bad news and fear amplify each other.
    sent = F.col("sentiment_mean")
    news = F.col("news_sensitivity") * sent * 10.0
    news = news - F.when(sent < -0.3, F.col("eff_fear") * F.abs(sent) * 8.0).otherwise(F.lit(0.0))
    s = s + F.coalesce(news, F.lit(0.0))
    pref = F.col("sector_preference")
    s = s + F.when(pref == "ALL", F.lit(0.0)).when(
        F.array_contains(F.split(pref, ","), F.coalesce(F.col("sector"), F.lit(""))), F.lit(3.0)).otherwise(F.lit(-1.0))
    return g.withColumn("stock_score", s)


def decision_grid(stocks: DataFrame, archetypes: DataFrame, regimes: DataFrame, by=("scenario_id", "dt"),
                  sentiment: DataFrame | None = None) -> DataFrame:
    """C17 + P2-P7: one decision per (group, archetype).

    ``stocks``: one row per (group keys, instrument) with the signal-table
    columns; ``sentiment``: (ticker, dt, sentiment_mean) of instruments with
    news that day, one row each. Returns target instrument, action, urgency, confidence, score
    and a reasoning string per (group, archetype).
    """
    by = list(by)
    spark = stocks.sparkSession
    ids = archetypes.select("archetype_id").orderBy("archetype_id")
    n_arch = len(BASE_ARCHETYPES) * VARIANTS
    arch = archetypes.withColumn("arch_no", F.row_number().over(Window.orderBy("archetype_id")) - 1)
    mods = regime_modifiers(spark)
    s = stocks.join(F.broadcast(regimes.select("dt", "regime_label")), "dt", "left") \
        .withColumn("regime_label", F.coalesce("regime_label", F.lit("Neutral"))) \
        .join(F.broadcast(mods), "regime_label", "left")
    if sentiment is None:
        s = s.withColumn("sentiment_mean", F.lit(None).cast("double"))
    else:
        s = s.join(sentiment.select("ticker", "dt", "sentiment_mean"), ["ticker", "dt"], "left")
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_arch - 1))).alias("arch_no"))
    g = score_grid(s.join(F.broadcast(arch), "arch_no"))
    grp = Window.partitionBy(*by, "archetype_id")
    temp = F.greatest(F.lit(0.5) + F.col("risk_tolerance") * 1.5, F.lit(0.1))
    g = g.withColumns({"__max": F.max("stock_score").over(grp), "__mean": F.avg("stock_score").over(grp),
                       "__sd": F.stddev_pop("stock_score").over(grp)})
    g = g.withColumn("__e", F.exp((F.col("stock_score") - F.col("__max")) / temp))
    cum_w = grp.orderBy("ticker").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("__cum", F.sum("__e").over(cum_w))
    g = g.withColumn("__tot", F.max("__cum").over(grp))
    u = stable_uniform(*by, "archetype_id", F.lit("pick"))
    g = g.withColumn("__hit", F.col("__cum") / F.col("__tot") > u)
    first = grp.orderBy(F.col("__hit").desc(), F.col("ticker"))
    g = g.withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    # Action probabilities for the chosen instrument.
    dd = F.col("__dd")
    deep = dd < -0.15
    ctr = F.col("contrarian_factor") > 0.3
    pb = F.col("buy_prob") + F.col("buy_bias") + F.coalesce("buy_pct", F.lit(0.25)) * 0.3 \
        + F.when(deep & ctr, 0.15).otherwise(0.0)
    pc = F.col("call_prob") + F.coalesce("call_pct", F.lit(0.25)) * 0.3 + F.when(deep & ctr, 0.10).otherwise(0.0)
    pp = F.col("put_prob") + F.coalesce("put_pct", F.lit(0.25)) * 0.3 + F.when(deep & ~ctr, 0.10).otherwise(0.0)
    ps = F.col("short_prob") - F.col("buy_bias") + F.coalesce("short_pct", F.lit(0.25)) * 0.3 \
        + F.when(deep & ~ctr, 0.10).otherwise(0.0)
    g = g.withColumns({"__pb": F.greatest(pb, F.lit(0.01)), "__pc": F.greatest(pc, F.lit(0.01)),
                       "__pp": F.greatest(pp, F.lit(0.01)), "__ps": F.greatest(ps, F.lit(0.01))})
    g = g.withColumn("__pt", F.col("__pb") + F.col("__pc") + F.col("__pp") + F.col("__ps"))
    u2 = stable_uniform(*by, "archetype_id", F.lit("act"))
    c1 = F.col("__pb") / F.col("__pt")
    c2 = c1 + F.col("__pc") / F.col("__pt")
    c3 = c2 + F.col("__pp") / F.col("__pt")
    action = F.when(u2 < c1, "BUY").when(u2 < c2, "CALL").when(u2 < c3, "PUT").otherwise("SHORT")
    # Urgency, confidence, reasoning.
    urg = F.col("urgency_base") + F.col("__gold") * 0.08 + F.coalesce("realized_vol_20d", F.lit(0.0)) * 0.5
    urg = urg + F.coalesce(F.abs("sentiment_mean") * 0.3, F.lit(0.0))
    urg = urg * (F.lit(0.5) + F.col("eff_greed") * 0.3 + (F.lit(1.0) - F.col("eff_fear")) * 0.2)
    urg = F.least(F.greatest(urg, F.lit(0.0)), F.lit(1.0))
    conf = (F.col("stock_score") - F.col("__mean")) / (F.col("__sd") + F.lit(1e-6)) * 0.3 + 0.5
    conf = F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))
    reason = F.concat_ws("; ", F.concat(F.lit("Regime="), F.col("regime_label")),
                         F.when(F.col("__gold") >= 3, F.concat(F.lit("score="), F.col("__gold").cast("int").cast("string"))),
                         F.when(dd < -0.10, F.concat(F.lit("drawdown="),
                                                     (F.round(dd * 1000.0) / 10.0).cast("string"), F.lit("%"))),
                         F.when(ctr, F.lit("contrarian_signal")))
    return g.select(*by, "archetype_id", "base_type", F.col("ticker").alias("target_ticker"),
                    F.col("sector").alias("target_sector"), action.alias("action"), _r3(urg).alias("urgency"),
                    _r3(conf).alias("confidence"), _r3(F.col("stock_score")).alias("stock_score"),
                    reason.alias("reasoning"), "regime_label")


def aggregate_flows(flows: DataFrame, by=("scenario_id", "dt")) -> DataFrame:
    """Per (group, instrument): agents per action, means, distinct base
    types, bullish ratio and net flow."""
    by = list(by)
    a = F.col("action")
    g = flows.groupBy(*by, F.col("target_ticker").alias("ticker")).agg(
        F.count(F.lit(1)).alias("agents"), F.count_if(a == "BUY").alias("buy_count"),
        F.count_if(a == "CALL").alias("call_count"), F.count_if(a == "PUT").alias("put_count"),
        F.count_if(a == "SHORT").alias("short_count"),
        # Urgency/confidence have 3 decimals: average the exact integer
        # milli-units so the mean does not depend on summation order.
        (F.sum(F.round(F.col("urgency") * 1000.0)) / (F.count(F.lit(1)) * 1000.0)).alias("avg_urgency"),
        (F.sum(F.round(F.col("confidence") * 1000.0)) / (F.count(F.lit(1)) * 1000.0)).alias("avg_confidence"),
        F.count_distinct("base_type").alias("base_types"))
    bull = F.col("buy_count") + F.col("call_count")
    bear = F.col("put_count") + F.col("short_count")
    return g.withColumns({"bullish_ratio": bull / F.col("agents"), "net_flow": bull - bear})


def benchmark_regimes(silver: DataFrame, benchmark="MKT", low=-0.05, high=0.05) -> DataFrame:
    """Stand-in regime table: Bull / Bear / Neutral by the benchmark's
    20-row summed return (> high, < low)."""
    b = silver.filter(F.col("ticker") == benchmark).select("dt", "rolling_return_20d")
    r = F.col("rolling_return_20d")
    return b.select("dt", F.when(r > high, "Bull").when(r < low, "Bear").otherwise("Neutral").alias("regime_label"))
