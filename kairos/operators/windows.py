"""Per-instrument window operators.

All operators use one window family ``partitionBy(key).orderBy(t)`` so that
Catalyst plans a single exchange and a single sort for a whole chain of
them; cross-sectional operators (per date) re-partition once by date.
Every rolling operator takes ``min_periods`` (1 = a partial frame is fine).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col_, div, safe_corr

SQRT_252 = math.sqrt(252.0)


def w(k="ticker", t="dt"):
    return Window.partitionBy(*([k] if isinstance(k, str) else k)).orderBy(t)


def frame(n: int, k="ticker", t="dt"):
    """Trailing frame of ``n`` rows ending at the current row."""
    return w(k, t).rowsBetween(-(n - 1), 0)


def rolling(agg: Column, value, n: int, min_periods: int = 1, k="ticker", t="dt") -> Column:
    """``agg`` over the trailing ``n`` rows; null until ``min_periods`` values."""
    out = agg.over(frame(n, k, t))
    if min_periods <= 1:
        return out
    return F.when(F.count(col_(value)).over(frame(n, k, t)) >= min_periods, out)


# --- E1, E2 -----------------------------------------------------------------

def with_returns(df: DataFrame, price="close", k="ticker", t="dt") -> DataFrame:
    """Previous close, simple return and log return."""
    prev = F.lag(price, 1).over(w(k, t))
    df = df.withColumn("prev_close", prev)
    return df.withColumns({
        "daily_return": div(F.col(price) - F.col("prev_close"), "prev_close"),
        "log_return": F.ln(div(price, "prev_close")),
    })


def with_drawdown(df: DataFrame, price="close", k="ticker", t="dt") -> DataFrame:
    """Running maximum and drawdown from it (always <= 0)."""
    run_max = F.max(price).over(w(k, t).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("running_max", run_max)
    return df.withColumn("drawdown_pct", div(F.col(price) - F.col("running_max"), "running_max"))


# --- E3, E4, E5: percentile ranks -------------------------------------------

def rank_key(c, digits: int = 10) -> Column:
    """Ranking key: the value rounded to ``digits`` decimals, so that
    equal values reached by different summation orders tie instead of
    being ordered by last-bit noise."""
    s = float(10 ** digits)
    return F.round(col_(c) * F.lit(s)) / F.lit(s)


def with_percent_rank(df: DataFrame, col: str, out: str, k="ticker", method="min",
                      ascending=True, round_digits: int | None = None) -> DataFrame:
    """Full-history percentile rank of ``col`` within ``k``.

    ``method="min"``: Spark ``percent_rank`` (nulls sort first and count).
    ``method="average"``: pandas ``rank(pct=True)``: average rank of ties
    among non-null values divided by the non-null count; null stays null.
    """
    part = [k] if isinstance(k, str) else list(k)
    if round_digits is not None:
        key = f"__rk_{out}"
        df = df.withColumn(key, rank_key(col, round_digits))
        return with_percent_rank(df, key, out, k, method, ascending).drop(key)
    if method == "min":
        o = F.col(col).asc_nulls_first() if ascending else F.col(col).desc_nulls_last()
        return df.withColumn(out, F.percent_rank().over(Window.partitionBy(*part).orderBy(o)))
    o = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    r = F.rank().over(Window.partitionBy(*part).orderBy(o))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, col))
    n = F.count(col).over(Window.partitionBy(*part))
    return df.withColumn(out, F.when(F.col(col).isNotNull(),
                                     (r + (ties - 1) / F.lit(2.0)) / n))


def with_trailing_percentile(df: DataFrame, col: str, out: str, n: int = 252,
                             min_periods: int = 60, k="ticker", t="dt") -> DataFrame:
    """E5: percentile of the current value among the previous ``n-1`` rows.

    Rank definition: (below + (equal > 0 ? (equal + 1) / 2 : 0)) / m over the
    m previous rows; null if the current value or any previous value in the
    frame is null, or fewer than ``min_periods`` non-null values in the
    ``n``-row frame including the current one.
    """
    prev = w(k, t).rowsBetween(-(n - 1), -1)
    arr = F.collect_list(col).over(prev)
    rows = F.count(F.lit(1)).over(prev)
    tmp = f"__arr_{out}"
    df = df.withColumn(tmp, arr).withColumn(f"__rows_{out}", rows)
    cur = F.col(col)
    a = F.col(tmp)
    m = F.size(a)
    below = F.size(F.filter(a, lambda x: x < cur))
    equal = F.size(F.filter(a, lambda x: x == cur))
    score = (below + F.when(equal > 0, (equal + 1) / F.lit(2.0)).otherwise(F.lit(0.0))) / m
    ok = (cur.isNotNull() & (m == F.col(f"__rows_{out}")) & (m > 0) & (m + 1 >= min_periods))
    return df.withColumn(out, F.when(ok, score)).drop(tmp, f"__rows_{out}")


# --- E6, E7: volatility -----------------------------------------------------

def with_realised_vol(df: DataFrame, ns=(20, 60), ret="daily_return", min_periods=1,
                      k="ticker", t="dt") -> DataFrame:
    """Annualised rolling standard deviation of returns."""
    return df.withColumns({
        f"realized_vol_{n}d": rolling(F.stddev_samp(ret), ret, n, min_periods, k, t) * F.lit(SQRT_252)
        for n in ns})


def with_vol_term(df: DataFrame) -> DataFrame:
    """20-day over 60-day volatility."""
    return df.withColumn("vol_term_structure", div("realized_vol_20d", "realized_vol_60d"))


# --- E8, E9, E10: RSI and MACD ---------------------------------------------

def with_rsi(df: DataFrame, n=14, ret="daily_return", zero_loss="cap", min_periods=1,
             k="ticker", t="dt") -> DataFrame:
    """RSI from simple averages of gains and losses over ``n`` rows.

    ``zero_loss="cap"``: rs = 100 when the mean loss is 0 (RSI 99.0099).
    ``zero_loss="neutral"``: RSI 50 in that case. ``"null"``: RSI null.
    """
    gain = F.when(F.col(ret) > 0, F.col(ret)).otherwise(F.lit(0.0))
    loss = F.when(F.col(ret) < 0, -F.col(ret)).otherwise(F.lit(0.0))
    df = df.withColumns({"gain": gain, "loss": loss})
    df = df.withColumns({
        f"avg_gain_{n}": rolling(F.avg("gain"), "gain", n, min_periods, k, t),
        f"avg_loss_{n}": rolling(F.avg("loss"), "loss", n, min_periods, k, t)})
    g, l_ = F.col(f"avg_gain_{n}"), F.col(f"avg_loss_{n}")
    if zero_loss == "cap":
        rs = F.when(l_ > 0, g / l_).otherwise(F.lit(100.0))
        rsi = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)
    elif zero_loss == "neutral":
        rsi = F.when(l_ > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + g / l_)).otherwise(F.lit(50.0))
    else:
        rsi = F.when(l_ > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + g / l_))
    return df.withColumn(f"rsi_{n}", rsi)


def ema_columns(df: DataFrame, specs, k="ticker", t="dt", block=64) -> DataFrame:
    """Exponential means with ``adjust=False`` (y0 = x0, y = y'(1-a) + x a).

    ``specs``: (out, source, span). A step is an affine map of y, and maps
    compose: the rows of a key are cut into time blocks, a running sum gives
    each row's map from its block's start, and the blocks' own maps are folded
    along the key, ``block`` times fewer than rows. All of it are native
    expressions; a null value leaves the mean as it was (null before the
    first value).
    """
    whole = Window.partitionBy(k).orderBy(t)
    inside = Window.partitionBy(k, "__block").orderBy("__pos")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__pos", F.row_number().over(whole) - 1).withColumn("__block", F.floor(F.col("__pos") / block))
    power, ends = {}, []
    for out, src, span in specs:
        a = 2.0 / (span + 1.0)
        x = F.col(src).cast("double")
        # Steps count values, not rows: i of this block, the key's first value has weight one.
        seen = F.count(x).over(whole.rowsBetween(Window.unboundedPreceding, 0))
        i = F.count(x).over(run)
        df = df.withColumns({f"__i_{out}": i, f"__n_{out}": seen})
        weight = F.when(F.col(f"__n_{out}") == 1, F.lit(1.0)).otherwise(F.lit(a))
        term = F.when(x.isNotNull(), x * weight * F.pow(F.lit(1.0 - a), -F.col(f"__i_{out}")))
        power[out] = F.pow(F.lit(1.0 - a), F.col(f"__i_{out}"))
        df = df.withColumn(f"__l_{out}", F.coalesce(F.sum(term).over(run), F.lit(0.0)) * power[out])
        ends += [F.max_by(f"__l_{out}", "__pos").alias(f"__l_{out}"), F.max_by(power[out], "__pos").alias(f"__d_{out}")]
    blocks = df.groupBy(k, "__block").agg(*ends)
    before = Window.partitionBy(k).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.aggregate(F.collect_list(F.struct(F.col(f"__l_{out}").alias("l"), F.col(f"__d_{out}").alias("d"))).over(before), F.lit(0.0),
                         lambda acc, e: acc * e["d"] + e["l"]).alias(f"__c_{out}") for out, _, _ in specs]
    df = df.join(blocks.select(k, "__block", *carry), [k, "__block"])
    df = df.withColumns({out: F.when(F.col(f"__n_{out}") > 0, F.col(f"__l_{out}") + F.col(f"__c_{out}") * power[out]) for out, _, _ in specs})
    return df.drop("__pos", "__block", *[f"__{c}_{out}" for out, _, _ in specs for c in "inlc"])


def with_macd(df: DataFrame, fast=12, slow=26, signal=9, kind="sma", price="close",
              k="ticker", t="dt") -> DataFrame:
    """MACD line, signal and histogram.

    ``kind="sma"``: simple averages (the columns keep the ema_* names).
    ``kind="ema"``: true exponential means (``adjust=False``).
    """
    if kind == "sma":
        df = df.withColumns({f"ema_{fast}": F.avg(price).over(frame(fast, k, t)),
                             f"ema_{slow}": F.avg(price).over(frame(slow, k, t))})
        df = df.withColumn("macd_line", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
        df = df.withColumn("macd_signal", F.avg("macd_line").over(frame(signal, k, t)))
    else:
        ef, es = f"ema_{fast}", f"ema_{slow}"
        df = ema_columns(df, [(ef, price, fast), (es, price, slow)], k, t).withColumn("macd_line", F.col(ef) - F.col(es))
        df = ema_columns(df, [("macd_signal", "macd_line", signal)], k, t)
    return df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


# --- E11 - E17 ---------------------------------------------------------------

def with_bollinger(df: DataFrame, n=20, nstd=2.0, price="close", min_periods=1,
                   k="ticker", t="dt") -> DataFrame:
    """Bollinger mid/std/upper/lower, %B (0.5 on zero std) and width."""
    df = df.withColumns({"bb_mid": rolling(F.avg(price), price, n, min_periods, k, t),
                         "bb_std": rolling(F.stddev_samp(price), price, n, min_periods, k, t)})
    df = df.withColumns({"bb_upper": F.col("bb_mid") + F.lit(nstd) * F.col("bb_std"),
                         "bb_lower": F.col("bb_mid") - F.lit(nstd) * F.col("bb_std")})
    return df.withColumns({
        "bb_pct_b": F.when(F.col("bb_std") > 0,
                           div(F.col(price) - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))
        .otherwise(F.lit(0.5)),
        "bb_width": div(F.col("bb_upper") - F.col("bb_lower"), "bb_mid")})


def with_atr(df: DataFrame, n=14, min_periods=1, k="ticker", t="dt") -> DataFrame:
    """Average true range; ``greatest`` skips the null terms of row 1."""
    pc = F.lag("close", 1).over(w(k, t))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    df = df.withColumn("true_range", tr)
    return df.withColumn(f"atr_{n}", rolling(F.avg("true_range"), "true_range", n, min_periods, k, t))


def with_roc(df: DataFrame, ns=(5, 20, 60), price="close", k="ticker", t="dt") -> DataFrame:
    """Rate of change over ``n`` rows."""
    return df.withColumns({
        f"roc_{n}": div(F.col(price) - F.lag(price, n).over(w(k, t)), F.lag(price, n).over(w(k, t)))
        for n in ns})


def with_zscore(df: DataFrame, col="close", ns=(20, 60), min_periods=1, prefix="zscore",
                k="ticker", t="dt") -> DataFrame:
    """Rolling z-score; zero or null std gives 0.0."""
    out = {}
    for n in ns:
        m = rolling(F.avg(col), col, n, min_periods, k, t)
        s = rolling(F.stddev_samp(col), col, n, min_periods, k, t)
        out[f"{prefix}_{n}d"] = F.when(s > 0, (F.col(col) - m) / s).otherwise(F.lit(0.0))
    return df.withColumns(out)


def with_sma(df: DataFrame, n=20, col="close", out=None, k="ticker", t="dt") -> DataFrame:
    """Simple moving average."""
    return df.withColumn(out or f"sma_{n}", F.avg(col).over(frame(n, k, t)))


def with_relative_return(df: DataFrame, n=20, kind="sum", k="ticker", t="dt") -> DataFrame:
    """Excess return over the benchmark and its ``n``-row sum.

    ``kind="sum"``: sum of daily excess returns. ``kind="compound"``: the
    ``n``-row price return minus the sum of the benchmark's daily returns.
    Needs ``bench_return`` (see C3).
    """
    df = df.withColumn("relative_return", F.col("daily_return") - F.col("bench_return"))
    if kind == "sum":
        return df.withColumn(f"relative_return_{n}d", F.sum("relative_return").over(frame(n, k, t)))
    r_n = div(F.col("close") - F.lag("close", n).over(w(k, t)), F.lag("close", n).over(w(k, t)))
    return df.withColumn(f"relative_return_{n}d", r_n - F.sum("bench_return").over(frame(n, k, t)))


def with_sector_zscore(df: DataFrame, col: str, out=None, sector="sector", t="dt") -> DataFrame:
    """Z-score of ``col`` within (sector, date); null std gives null."""
    ws = Window.partitionBy(sector, t)
    return df.withColumn(out or f"{col}_sector_z",
                         div(F.col(col) - F.avg(col).over(ws), F.stddev_samp(col).over(ws)))


# --- E19 - E23 ----------------------------------------------------------------

def with_forward_return(df: DataFrame, ns=(5, 20, 60), price="close", k="ticker", t="dt") -> DataFrame:
    """Forward return over ``n`` rows (null in the last ``n`` rows)."""
    return df.withColumns({
        f"fwd_return_{n}d": div(F.lead(price, n).over(w(k, t)) - F.col(price), price) for n in ns})


def sorted_quantile(arr: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted, null-free array (numpy
    ``linear``; same arithmetic as Spark's ``percentile``)."""
    n = F.size(arr)
    pos = (n - 1).cast("double") * F.lit(p)
    lo, hi = F.floor(pos), F.ceil(pos)
    lo_v = F.element_at(arr, (lo + 1).cast("int"))
    hi_v = F.element_at(arr, (hi + 1).cast("int"))
    return F.when(n > 0, F.when(lo == hi, lo_v).otherwise((hi - pos) * lo_v + (pos - lo) * hi_v))


def with_forward_distribution(df: DataFrame, n=60, min_n=10, ret="daily_return",
                              full_only=False, k="ticker", t="dt") -> DataFrame:
    """Population skew and p5/p25/p50/p75/p95 of the next ``n`` daily
    returns, when at least ``min_n`` of them are non-null.

    Native frame aggregates, no Python: the frame's values are collected
    once, sorted once, and the five quantiles are read off the sorted array
    (cheaper than five ``percentile`` hash-map aggregates per row).
    """
    fw = w(k, t).rowsBetween(1, n)
    df = df.withColumns({
        "__fwd_arr": F.array_sort(F.collect_list(ret).over(fw)),
        "__fwd_skew": F.skewness(ret).over(fw)})
    if full_only:
        df = df.withColumn("__fwd_rows", F.count(F.lit(1)).over(fw))
    ok = F.size("__fwd_arr") >= min_n
    if full_only:
        ok = ok & (F.col("__fwd_rows") == n)
    names = [("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)]
    out = {f"fwd_{n}d_skew": F.when(ok, F.col("__fwd_skew"))}
    for nm, p in names:
        out[f"fwd_{n}d_{nm}"] = F.when(ok, sorted_quantile(F.col("__fwd_arr"), p))
    return df.withColumns(out).drop("__fwd_arr", "__fwd_skew", "__fwd_rows")


def with_mean_reversion(df: DataFrame, n_sum=20, n_corr=60, ret="daily_return",
                        k="ticker", t="dt") -> DataFrame:
    """Correlation of the 20-row summed return with its lag over 60 rows."""
    df = df.withColumn(f"rolling_return_{n_sum}d", F.sum(ret).over(frame(n_sum, k, t)))
    df = df.withColumn("rolling_return_lag1", F.lag(f"rolling_return_{n_sum}d", 1).over(w(k, t)))
    return df.withColumn("mean_reversion_score",
                         safe_corr(f"rolling_return_{n_sum}d", "rolling_return_lag1", frame(n_corr, k, t)))


def with_autocorr(df: DataFrame, col="daily_return", n=60, out="autocorr_lag1",
                  k="ticker", t="dt") -> DataFrame:
    """Lag-1 autocorrelation inside a full ``n``-row frame (n-1 pairs)."""
    df = df.withColumn("__lag1", F.lag(col, 1).over(w(k, t)))
    full = F.count(col).over(frame(n, k, t)) == n
    val = safe_corr(col, "__lag1", w(k, t).rowsBetween(-(n - 2), 0))
    return df.withColumn(out, F.when(full, val)).drop("__lag1")


def with_obv(df: DataFrame, n=20, k="ticker", t="dt") -> DataFrame:
    """On-balance volume and its ``n``-row least-squares slope."""
    d = F.col("close") - F.lag("close", 1).over(w(k, t))
    signed = F.coalesce(F.signum(d) * F.col("volume"), F.lit(0.0))
    df = df.withColumn("obv", F.sum(signed).over(w(k, t).rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__idx", F.row_number().over(w(k, t)).cast("double"))
    full = F.count(F.lit(1)).over(frame(n, k, t)) == n
    slope = F.regr_slope("obv", "__idx").over(frame(n, k, t))
    return df.withColumn(f"obv_slope_{n}d", F.when(full, F.coalesce(slope, F.lit(0.0)))).drop("__idx")


def with_stochastic(df: DataFrame, n=14, d=3, min_periods=None, k="ticker", t="dt") -> DataFrame:
    """Stochastic %K over ``n`` rows and its ``d``-row mean %D."""
    mp = n if min_periods is None else min_periods
    lo = rolling(F.min("low"), "low", n, mp, k, t)
    hi = rolling(F.max("high"), "high", n, mp, k, t)
    df = df.withColumn("stoch_k", F.lit(100.0) * div(F.col("close") - lo, hi - lo))
    return df.withColumn("stoch_d", rolling(F.avg("stoch_k"), "stoch_k", d, d, k, t))


def with_mfi(df: DataFrame, n=14, k="ticker", t="dt") -> DataFrame:
    """Money flow index over ``n`` rows (full frames only)."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / F.lit(3.0)
    df = df.withColumn("__tp", tp)
    prev = F.lag("__tp", 1).over(w(k, t))
    mf = F.col("__tp") * F.col("volume")
    df = df.withColumns({"__pos": F.when(F.col("__tp") > prev, mf).otherwise(F.lit(0.0)),
                         "__neg": F.when(F.col("__tp") <= prev, mf).otherwise(F.lit(0.0))})
    full = F.count(F.lit(1)).over(frame(n, k, t)) == n
    pos = F.sum("__pos").over(frame(n, k, t))
    neg = F.sum("__neg").over(frame(n, k, t))
    df = df.withColumn(f"mfi_{n}", F.when(full, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + div(pos, neg))))
    return df.drop("__tp", "__pos", "__neg")


# --- E28 - E30: irregular series and news --------------------------------------

def macro_features(df: DataFrame, k="series_id", t="observation_date", v="value", n=20) -> DataFrame:
    """Change, pct change (null if previous null or 0), rolling z (else 0)."""
    prev = F.lag(v, 1).over(w(k, t))
    df = df.withColumn("__prev", prev)
    m = F.avg(v).over(frame(n, k, t))
    s = F.stddev_samp(v).over(frame(n, k, t))
    df = df.withColumns({
        "daily_change": F.col(v) - F.col("__prev"),
        "pct_change": F.when(F.col("__prev").isNotNull() & (F.col("__prev") != 0),
                             div(F.col(v) - F.col("__prev"), "__prev")),
        f"zscore_{n}d": F.when(s > 0, (F.col(v) - m) / s).otherwise(F.lit(0.0))})
    return df.drop("__prev")


def news_rolling(df: DataFrame, k="ticker", t="published_date") -> DataFrame:
    """Rolling news counts/tone over rows that have news."""
    df = df.withColumns({
        "news_count_3d": F.avg("article_count").over(frame(3, k, t)),
        "news_count_7d": F.avg("article_count").over(frame(7, k, t)),
        "tone_3d": F.avg("avg_tone").over(frame(3, k, t)),
        "__tone_lag3": F.lag("avg_tone", 3).over(w(k, t)),
        "__cnt_m": F.avg("article_count").over(frame(7, k, t)),
        "__cnt_s": F.stddev_samp("article_count").over(frame(7, k, t))})
    df = df.withColumns({
        "tone_delta_3d": F.col("avg_tone") - F.col("__tone_lag3"),
        "news_count_zscore": F.when(F.col("__cnt_s") > 0,
                                    (F.col("article_count") - F.col("__cnt_m")) / F.col("__cnt_s"))
        .otherwise(F.lit(0.0))})
    return df.drop("__tone_lag3", "__cnt_m", "__cnt_s")


def sentiment_rolling(df: DataFrame, k="ticker", t="published_date", col="avg_sentiment") -> DataFrame:
    """Sentiment delta vs 3 rows back and 3-row mean."""
    return df.withColumns({
        "sentiment_delta_3d": F.col(col) - F.lag(col, 3).over(w(k, t)),
        "sentiment_3d": F.avg(col).over(frame(3, k, t))})


# --- E31 - E36: cross-sectional and group positions ------------------------------

def with_xs_rank(df: DataFrame, cols, t="dt", suffix="_xs_rank") -> DataFrame:
    """Percent rank of each column among instruments of the same date."""
    return df.withColumns({
        f"{c}{suffix}": F.percent_rank().over(Window.partitionBy(t).orderBy(F.col(c).asc_nulls_first()))
        for c in cols})


def with_rarity(df: DataFrame, t="dt", score="signal_score", tiebreak="drawdown_percentile") -> DataFrame:
    """Per-date percent rank by (score, tiebreak)."""
    ws = Window.partitionBy(t).orderBy(F.col(score).asc_nulls_first(), F.col(tiebreak).asc_nulls_first())
    return df.withColumn("rarity_percentile", F.percent_rank().over(ws))


def pct_of_total(df: DataFrame, count_col: str, within=None, out="pct") -> DataFrame:
    """Share of total, as a percentage, within ``within`` (or overall)."""
    ws = Window.partitionBy(*within) if within else Window.partitionBy()
    return df.withColumn(out, F.col(count_col) * F.lit(100.0) / F.sum(count_col).over(ws))


def grid_positions(df: DataFrame, by, order) -> DataFrame:
    """Index inside group, ceil(sqrt(n)) columns, row and column."""
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    df = df.withColumns({"idx": F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1,
                         "group_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    df = df.withColumn("grid_cols", F.ceil(F.sqrt(F.col("group_n").cast("double"))).cast("int"))
    return df.withColumns({"grid_row": (F.col("idx") / F.col("grid_cols")).cast("int"),
                           "grid_col": (F.col("idx") % F.col("grid_cols")).cast("int")})


# --- E26: Hurst exponent ------------------------------------------------------

def hurst_array(ret, n=252, max_lag=20):
    """Rolling R/S Hurst exponent over the previous ``n`` values (numpy).

    Row i (i >= n) uses ret[i-n:i]; lags 2..max_lag-1; chunks of each lag
    start at 0, lag, ... while start < n - lag; chunks with NaN or zero std
    are skipped; slope of log(mean R/S) on log(lag) over >= 3 valid lags,
    clipped to [0, 1]; fewer valid lags -> 0.5. Rows before ``n`` -> NaN.
    """
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    x = np.asarray(ret, dtype="float64")
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    win = sliding_window_view(x, n)[: len(x) - n]  # win[j] = x[j:j+n] -> row j+n
    lags = np.arange(2, max_lag)
    taus = np.full((win.shape[0], len(lags)), np.nan)
    for li, lag in enumerate(lags):
        m = len(range(0, n - lag, lag))
        ch = win[:, : m * lag].reshape(win.shape[0], m, lag)
        mean = ch.mean(axis=2, keepdims=True)
        cum = np.cumsum(ch - mean, axis=2)
        r = cum.max(axis=2) - cum.min(axis=2)
        sd = ch.std(axis=2, ddof=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = np.isfinite(sd) & (sd > 0) & np.isfinite(r)
            rs = np.where(ok, r / np.where(ok, sd, 1.0), 0.0)
            cnt = ok.sum(axis=1)
            taus[:, li] = np.where(cnt > 0, rs.sum(axis=1) / np.maximum(cnt, 1), np.nan)
    lx = np.log(lags.astype("float64"))
    valid = np.isfinite(taus) & (taus > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        ly = np.where(valid, np.log(np.where(valid, taus, 1.0)), 0.0)
    k = valid.sum(axis=1)
    sx = (valid * lx).sum(axis=1)
    sy = ly.sum(axis=1)
    sxx = (valid * lx * lx).sum(axis=1)
    sxy = (ly * lx).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        slope = (k * sxy - sx * sy) / (k * sxx - sx * sx)
    h = np.where(k >= 3, np.clip(slope, 0.0, 1.0), 0.5)
    out[n:] = h
    return out


def with_hurst(df: DataFrame, col="daily_return", n=252, max_lag=20, out="hurst_exponent",
               k="ticker", t="dt") -> DataFrame:
    """Rolling Hurst exponent per instrument (grouped ``applyInPandas``;
    one group = one instrument's history, bounded by the calendar)."""
    from pyspark.sql import types as T

    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.DoubleType())])
    names = schema.fieldNames()

    def run(pdf):
        pdf = pdf.sort_values(t, kind="mergesort")
        pdf[out] = hurst_array(pdf[col].to_numpy(dtype="float64"), n, max_lag)
        return pdf[names]

    return df.groupBy(k).applyInPandas(run, schema)
