"""Data-quality and validation operators.

A check is a row (layer, name, value, threshold, passed). Each table is
read by one aggregation; the results are unpivoted to rows inside the plan
(no driver round trip per check).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_checks(df: DataFrame, layer: str, rules: list) -> DataFrame:
    """M1: ``rules`` = [(name, aggregate, threshold_text, passed_fn)], where
    ``passed_fn(value_col) -> Column``. One ``agg`` pass, then ``inline``."""
    agg = df.agg(*[a.cast("double").alias(f"__v{i}") for i, (_, a, _, _) in enumerate(rules)])
    rows = []
    for i, (name, _, thr, ok) in enumerate(rules):
        v = F.col(f"__v{i}")
        rows.append(F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("name"), v.alias("value"),
                             F.lit(thr).alias("threshold"), F.coalesce(ok(v), F.lit(False)).alias("passed")))
    return agg.select(F.inline(F.array(*rows)))


def _eq0(v):
    return v == 0


def bronze_checks(bars: DataFrame, min_rows=100000, min_tickers=400, min_sectors=8) -> DataFrame:
    """M2: row count, distinct instruments, nulls, negative price/volume,
    duplicate keys, sector count."""
    dup = bars.groupBy("ticker", "dt").agg(F.count(F.lit(1)).alias("n")).filter("n > 1") \
        .agg(F.count(F.lit(1)).alias("dups"))
    base = bars.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"),
                    *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("ticker", "dt", "close", "volume")],
                    F.count_if(F.col("close") < 0).alias("neg_close"), F.count_if(F.col("volume") < 0).alias("neg_vol"),
                    F.count_distinct("sector").alias("sectors"))
    one = base.withColumn("__k", F.lit(1)).join(dup.withColumn("__k", F.lit(1)), "__k").drop("__k")
    rules = [("row_count", F.first("rows"), f">{min_rows}", lambda v: v > min_rows),
             ("distinct_tickers", F.first("tickers"), f">{min_tickers}", lambda v: v > min_tickers)]
    rules += [(f"null_{c}", F.first(f"null_{c}"), "0", _eq0) for c in ("ticker", "dt", "close", "volume")]
    rules += [("negative_prices", F.first("neg_close"), "0", _eq0),
              ("negative_volumes", F.first("neg_vol"), "0", _eq0),
              ("duplicate_ticker_dates", F.first("dups"), "0", _eq0),
              ("sector_count", F.first("sectors"), f">={min_sectors}", lambda v: v >= min_sectors)]
    return run_checks(one, "bronze", rules)


# Writer names for the columns readers ask for.
SILVER_FEATURES = {"rsi_14": "rsi_14", "macd": "macd_line", "bb_upper": "bb_upper", "bb_lower": "bb_lower",
                   "sma_20": "bb_mid", "volatility_20d": "realized_vol_20d"}


def silver_checks(silver: DataFrame, min_rows=100000, max_null_pct=10.0) -> DataFrame:
    """M3: row count, feature null % < 10, RSI in [0, 100], vol >= 0."""
    n = F.count(F.lit(1))
    rules = [("row_count", n, f">{min_rows}", lambda v: v > min_rows)]
    for name, col in SILVER_FEATURES.items():
        rules.append((f"null_pct_{name}", F.count_if(F.col(col).isNull()) * 100.0 / n, f"<{max_null_pct}",
                      lambda v: v < max_null_pct))
    rules += [("rsi_range", F.count_if(F.col("rsi_14").isNotNull() & ((F.col("rsi_14") < 0) | (F.col("rsi_14") > 100))),
               "0", _eq0),
              ("negative_volatility", F.count_if(F.col("realized_vol_20d") < 0), "0", _eq0),
              ("latest_date_days", F.datediff(F.max("dt"), F.lit("1970-01-01")), "", lambda v: F.lit(True))]
    return run_checks(silver, "silver", rules)


def gold_checks(gold: DataFrame, min_tickers=400, min_sectors=8) -> DataFrame:
    """M4: instruments, top-tier share in (0, 10) %, null/out-of-range score,
    sectors."""
    n = F.count(F.lit(1))
    rules = [("ticker_count", F.count_distinct("ticker"), f">{min_tickers}", lambda v: v > min_tickers),
             ("top_tier_pct", F.count_if(F.col("top_tier")) * 100.0 / n, "(0,10)", lambda v: (v > 0) & (v < 10)),
             ("null_score", F.count_if(F.col("signal_score").isNull()), "0", _eq0),
             ("score_range", F.count_if((F.col("signal_score") < 0) | (F.col("signal_score") > 5)), "0", _eq0),
             ("sector_count", F.count_distinct("sector"), f">={min_sectors}", lambda v: v >= min_sectors)]
    return run_checks(gold, "gold", rules)


def quality_report(checks: DataFrame) -> DataFrame:
    """M6: per layer: checks, failed, status."""
    return checks.groupBy("layer").agg(F.count(F.lit(1)).alias("total_checks"),
                                       F.count_if(~F.col("passed")).alias("failed_checks")) \
        .withColumn("status", F.when(F.col("failed_checks") > 0, "fail").otherwise("pass"))


def layer_integrity(upper: DataFrame, lower: DataFrame, k="ticker", max_loss=0.01, max_lost_keys=2) -> DataFrame:
    """M7: row-loss ratio between layers and keys lost."""
    a = upper.agg(F.count(F.lit(1)).alias("upper_rows"), F.lit(1).alias("__k"))
    b = lower.agg(F.count(F.lit(1)).alias("lower_rows"), F.lit(1).alias("__k"))
    lost = upper.select(k).distinct().join(lower.select(k).distinct(), k, "left_anti") \
        .agg(F.count(F.lit(1)).alias("keys_lost"), F.lit(1).alias("__k"))
    j = a.join(b, "__k").join(lost, "__k").drop("__k")
    loss = (F.col("upper_rows") - F.col("lower_rows")) / F.col("upper_rows")
    return j.withColumn("loss_ratio", loss).withColumn(
        "passed", (F.col("loss_ratio") < max_loss) & (F.col("keys_lost") <= max_lost_keys))


def completeness(df: DataFrame, cols) -> DataFrame:
    """M8: null count and null % for each column (one pass, unpivoted)."""
    n = F.count(F.lit(1))
    return run_checks(df, "completeness",
                      [(c, F.count_if(F.col(c).isNull()) * 100.0 / n, "<10", lambda v: v < 10) for c in cols])


def orphans(child: DataFrame, parent: DataFrame, k) -> DataFrame:
    """M9: child keys without a parent row."""
    k = [k] if isinstance(k, str) else list(k)
    return child.select(*k).distinct().join(parent.select(*k).distinct(), k, "left_anti")


def values_match(a: DataFrame, b: DataFrame, on, col: str, tol=1e-4) -> DataFrame:
    """Rows joined on keys; count of |a - b| > tol."""
    j = a.select(*on, F.col(col).alias("__a")).join(b.select(*on, F.col(col).alias("__b")), on, "inner")
    return j.agg(F.count(F.lit(1)).alias("compared"),
                 F.count_if(F.abs(F.col("__a") - F.col("__b")) > tol).alias("mismatches"))


def check_forward(df: DataFrame, n=5, price="close", col=None, k="ticker", t="dt", tol=1e-9) -> DataFrame:
    """Recompute the forward return from ``lead``; count mismatches
    and values present where no future row exists (leaks)."""
    col = col or f"fwd_return_{n}d"
    w = Window.partitionBy(k).orderBy(t)
    fut = F.lead(price, n).over(w)
    x = df.withColumn("__f", fut).withColumn("__re", F.try_divide(F.col("__f") - F.col(price), F.col(price)))
    return x.agg(F.count_if(F.col(col).isNotNull() & F.col("__re").isNotNull()
                            & (F.abs(F.col(col) - F.col("__re")) > tol)).alias("mismatched"),
                 F.count_if(F.col(col).isNotNull() & F.col("__f").isNull()).alias("leaked"),
                 F.count(F.lit(1)).alias("rows"))


def check_backward(df: DataFrame, n=20, col="bb_mid", price="close", k="ticker", t="dt", tol=1e-6) -> DataFrame:
    """Recompute the n-row mean in frame; compare on full windows only."""
    fr = Window.partitionBy(k).orderBy(t).rowsBetween(-(n - 1), 0)
    x = df.withColumns({"__m": F.avg(price).over(fr), "__c": F.count(F.lit(1)).over(fr)}).filter(F.col("__c") == n)
    return x.agg(F.count(F.lit(1)).alias("checked"),
                 F.count_if(F.abs(F.col(col) - F.col("__m")) > tol).alias("mismatches"))


def check_drawdown(df: DataFrame) -> DataFrame:
    """Drawdown must never be positive."""
    return df.agg(F.count_if(F.col("drawdown_pct") > 0).alias("positive_drawdowns"),
                  F.min("drawdown_pct").alias("deepest_drawdown"))


def regime_share(regimes: DataFrame, start: str, end: str, t="dt") -> DataFrame:
    """Share of each regime label inside a period."""
    p = regimes.filter((F.col(t) >= F.to_date(F.lit(start))) & (F.col(t) <= F.to_date(F.lit(end))))
    g = p.groupBy("regime_label").agg(F.count(F.lit(1)).alias("days"))
    return g.withColumn("pct", F.col("days") * 100.0 / F.sum("days").over(Window.partitionBy()))


def pipeline_status(gold: DataFrame, silver: DataFrame, t="dt") -> DataFrame:
    """Dates processed in gold vs available in silver."""
    g = gold.agg(F.count_distinct(t).alias("dates_processed"), F.min(t).alias("first_processed"),
                 F.max(t).alias("last_processed"), F.lit(1).alias("__k"))
    s = silver.agg(F.count_distinct(t).alias("dates_available"), F.max(t).alias("last_available"),
                   F.lit(1).alias("__k"))
    j = g.join(s, "__k").drop("__k")
    return j.withColumn("dates_remaining", F.col("dates_available") - F.col("dates_processed"))


def build_quality(latest: DataFrame) -> DataFrame:
    """Counters over the latest snapshot rows."""
    return latest.agg(F.count(F.lit(1)).alias("stocks"),
                      F.count_if(F.col("signal_score") > 0).alias("with_signal"),
                      F.count_if(F.col("top_tier")).alias("top_tier"),
                      F.count_if(F.col("close") <= 0).alias("bad_price"),
                      F.count_if(F.col("sector").isNull()).alias("no_sector"))
