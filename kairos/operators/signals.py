"""Threshold signals and scores (F1-F16).

Thresholds are parameters with the source's values as defaults.
Column names are neutral: signal_1 .. signal_5, signal_score, top_tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col_, flag, lerp

# Default signal thresholds.
DEFAULTS = dict(
    dip_dd=0.80,
    shock_dd=0.85, shock_volume=0.90, shock_vol=0.85,
    asym_dd=0.85, asym_skew=0.0, asym_p95_mult=2.0,
    disl_dd=0.80, disl_rel=0.15, disl_mr=-0.1,
    conv_dd=0.90, conv_volume=0.90, conv_rel=0.15, conv_skew=0.5,
    top_score=4, top_rarity=0.98, top_skew=1.0, top_rel=0.05,
)


def _p(params, name):
    return (params or {}).get(name, DEFAULTS[name])


def signal_dip(p=None) -> Column:
    """deep drawdown percentile."""
    return flag(F.col("drawdown_percentile") > _p(p, "dip_dd"))


def signal_shock(p=None) -> Column:
    """drawdown + volume + volatility extremes."""
    return flag((F.col("drawdown_percentile") > _p(p, "shock_dd"))
                & (F.col("volume_percentile") > _p(p, "shock_volume"))
                & (F.col("vol_percentile") > _p(p, "shock_vol")))


def signal_asymmetry(p=None, abs_median=False) -> Column:
    """skewed forward distribution with a bounded downside."""
    med = F.abs(F.col("fwd_60d_median")) if abs_median else F.col("fwd_60d_median")
    return flag((F.col("drawdown_percentile") > _p(p, "asym_dd"))
                & (F.col("fwd_60d_skew") > _p(p, "asym_skew"))
                & (F.col("fwd_60d_p95") > F.lit(_p(p, "asym_p95_mult")) * med)
                & (F.col("fwd_60d_p5") > F.col("median_drawdown")))


def signal_dislocation(p=None) -> Column:
    """underperformance with mean-reverting behaviour."""
    return flag((F.col("drawdown_percentile") > _p(p, "disl_dd"))
                & (F.col("relative_return_percentile") < _p(p, "disl_rel"))
                & (F.col("mean_reversion_score") < _p(p, "disl_mr")))


def signal_convexity(p=None) -> Column:
    """all extremes at once in a favourable volatility regime."""
    return flag((F.col("drawdown_percentile") > _p(p, "conv_dd"))
                & (F.col("volume_percentile") > _p(p, "conv_volume"))
                & (F.col("relative_return_percentile") < _p(p, "conv_rel"))
                & (F.col("fwd_60d_skew") > _p(p, "conv_skew"))
                & (F.col("vol_regime") == "favorable"))


def with_signals(df: DataFrame, params=None) -> DataFrame:
    """The five flags and their sum."""
    df = df.withColumns({"signal_1": signal_dip(params), "signal_2": signal_shock(params),
                         "signal_3": signal_asymmetry(params), "signal_4": signal_dislocation(params),
                         "signal_5": signal_convexity(params)})
    score = sum(F.col(f"signal_{i}").cast("int") for i in range(1, 6))
    return df.withColumn("signal_score", score)


# Thresholds of the one-day scorer.
DAY = dict(dip_dd=0.80, shock_dd=0.85, shock_volume=0.90, shock_vol=0.85, asym_dd=0.85, asym_fwd60=0.05, asym_fwd5=-0.03,
           disl_dd=0.80, disl_mom=-0.05, conv_dd=0.90, conv_volume=0.90, conv_vol=0.85, conv_mom=-0.08, conv_fwd60=0.10, top_score=4)


def day_score(df: DataFrame, p=DAY) -> DataFrame:
    """the signals of single days from that day's feature rows alone; the
    forward distribution is replaced by forward returns and the relative
    return by momentum. Top tier by score only."""
    dd, volume, vol = F.col("drawdown_percentile"), F.col("volume_percentile"), F.col("vol_percentile")
    m5, m20 = F.col("roc_5"), F.col("roc_20")
    f5, f60 = F.col("fwd_return_5d"), F.col("fwd_return_60d")
    flags = {
        "signal_1": dd > p["dip_dd"],
        "signal_2": (dd > p["shock_dd"]) & (volume > p["shock_volume"]) & (vol > p["shock_vol"]),
        "signal_3": (dd > p["asym_dd"]) & (f60 > p["asym_fwd60"]) & (f5 > p["asym_fwd5"]),
        "signal_4": (dd > p["disl_dd"]) & (m20 < p["disl_mom"]) & (m5 > m20),
        "signal_5": (dd > p["conv_dd"]) & (volume > p["conv_volume"]) & (vol > p["conv_vol"]) & (m20 < p["conv_mom"]) & (f60 > p["conv_fwd60"]),
    }
    df = df.withColumns({n: flag(c) for n, c in flags.items()})
    df = df.withColumn("signal_score", sum(F.col(n).cast("int") for n in flags))
    return df.withColumn("top_tier", F.col("signal_score") >= p["top_score"])


def with_top_tier(df: DataFrame, params=None, kind="full") -> DataFrame:
    """top tier flag. ``kind="full"`` (all conditions) or ``"score"``
    (score >= 4 only)."""
    cond = F.col("signal_score") >= _p(params, "top_score")
    if kind == "full":
        cond = (cond & (F.col("rarity_percentile") > _p(params, "top_rarity"))
                & (F.col("fwd_60d_skew") > _p(params, "top_skew"))
                & (F.col("relative_return_percentile") < _p(params, "top_rel"))
                & (F.col("vol_regime") == "favorable"))
    return df.withColumn("top_tier", flag(cond))


# Direction-bias table (buy, call, put, short) per branch.
BIAS_BRANCHES = [
    ("strong_up", (0.50, 0.30, 0.10, 0.10)),
    ("flat_skewed", (0.20, 0.50, 0.20, 0.10)),
    ("negative_skew", (0.10, 0.10, 0.45, 0.35)),
    ("default", (0.30, 0.25, 0.25, 0.20)),
]


def case_table(conditions: list[Column], outputs: dict[str, list]) -> dict[str, Column]:
    """B2: ordered multi-branch CASE producing several outputs from one list
    of conditions (the last output value is the ELSE branch)."""
    res = {}
    for name, vals in outputs.items():
        e = None
        for c, v in zip(conditions, vals[:-1]):
            e = F.when(c, F.lit(v)) if e is None else e.when(c, F.lit(v))
        res[name] = e.otherwise(F.lit(vals[-1]))
    return res


def with_direction_bias(df: DataFrame, kind="branch") -> DataFrame:
    """F8: buy/call/put/short weights. ``kind="equal"``: 0.25 each."""
    names = ["buy_pct", "call_pct", "put_pct", "short_pct"]
    if kind == "equal":
        return df.withColumns({n: F.lit(0.25) for n in names})
    sk, md = F.col("fwd_60d_skew"), F.col("fwd_60d_median")
    conds = [(sk > 0.5) & (md > 0.02), (sk > 0.3) & (F.abs(md) < 0.02), sk < -0.3]
    outputs = {n: [b[1][i] for b in BIAS_BRANCHES] for i, n in enumerate(names)}
    return df.withColumns(case_table(conds, outputs))


def direction_bias_momentum(mom="roc_5", dd="drawdown_pct") -> dict[str, Column]:
    """heuristic bias from 5-day momentum and drawdown (null -> 0)."""
    m = F.coalesce(F.col(mom), F.lit(0.0))
    d = F.coalesce(F.col(dd), F.lit(0.0))
    buy = F.when(m > 0, F.lit(0.35)).otherwise(F.lit(0.2))
    short = F.when(m > 0, F.lit(0.15)).otherwise(F.lit(0.3))
    call = F.when(d < -0.1, F.lit(0.3)).otherwise(F.lit(0.25))
    put = F.greatest(F.lit(1.0) - buy - short - call, F.lit(0.05))
    return {"buy_pct": buy, "call_pct": call, "put_pct": F.round(put, 2), "short_pct": short}


def with_size_rank(df: DataFrame, k="ticker", volume="volume") -> DataFrame:
    """Size percentile = percent rank of the instrument's mean volume.

    The ranked table has one row per instrument (bounded by the instrument
    universe); it is joined back on the key.
    """
    per = df.groupBy(k).agg(F.avg(volume).alias("avg_volume"))
    per = per.withColumn("size_percentile",
                         F.percent_rank().over(Window.orderBy(F.col("avg_volume").asc_nulls_first())))
    return df.join(per.select(k, "size_percentile"), k, "left")


def with_dimensions(df: DataFrame, mult=2.5) -> DataFrame:
    """footprint by size rank (lerp), scaled for the top tier; glow."""
    sp = F.col("size_percentile")
    top = F.col("top_tier")
    df = df.withColumns({"width": lerp(sp, 1.0, 3.0), "height": lerp(sp, 1.5, 4.0),
                         "depth": lerp(sp, 1.0, 2.0),
                         "glow": F.col("signal_score").cast("double") / F.lit(5.0)})
    return df.withColumns({c: F.when(top, F.col(c) * F.lit(mult)).otherwise(F.col(c))
                           for c in ("width", "height", "depth")})


def with_density(df: DataFrame) -> DataFrame:
    """density 200 + floor(score^2.5 * 800) (x3 top tier); speed."""
    s = F.col("signal_score").cast("double")
    dens = F.lit(200) + F.floor(F.pow(s, F.lit(2.5)) * F.lit(800))
    dens = F.when(F.col("top_tier"), (dens * 3).cast("long")).otherwise(dens.cast("long"))
    return df.withColumns({"density": dens, "speed": F.lit(1.0) + s * F.lit(1.5)})


def approx_distribution(center="fwd_return_60d", vol="realized_vol_20d", mom="roc_5") -> dict[str, Column]:
    """forward distribution sketched from a centre and a volatility;
    fixed fallbacks when the volatility is null or 0; skew = momentum / 2."""
    c = F.coalesce(F.col(center), F.lit(0.0))
    v = F.col(vol)
    has = v.isNotNull() & (v != 0)
    return {"p5": F.when(has, c - v * F.lit(1.6)).otherwise(F.lit(-0.08)),
            "p25": F.when(has, c - v * F.lit(0.7)).otherwise(F.lit(-0.02)),
            "median": c,
            "p75": F.when(has, c + v * F.lit(0.7)).otherwise(F.lit(0.05)),
            "p95": F.when(has, c + v * F.lit(1.6)).otherwise(F.lit(0.12)),
            "skew": F.coalesce(F.col(mom), F.lit(0.0)) * F.lit(0.5)}


def news_attention(has="has_news", z="news_count_zscore", tone="avg_tone", std="tone_std") -> Column:
    """0.5|z| + 0.3|tone| + 0.2 std on rows with news, else 0."""
    return F.when(F.col(has), F.lit(0.5) * F.abs(F.col(z)) + F.lit(0.3) * F.abs(F.col(tone))
                  + F.lit(0.2) * F.col(std)).otherwise(F.lit(0.0))
