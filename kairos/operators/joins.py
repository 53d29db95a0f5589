"""Join operators.

Dimension sides are broadcast only where their size is bounded by a fixed
universe (sectors, regimes, calendar dates, archetypes) and never by the
fact data; everything else is left to Catalyst/AQE (sort-merge or shuffled
hash join, with skew-join splitting on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col_


def with_sector(df: DataFrame, dim: DataFrame, k="ticker", keep="last", order=None) -> DataFrame:
    """Left join a small sector map, one row per key (S12: the map is
    de-duplicated first, so duplicate keys never multiply fact rows)."""
    if order is not None:
        o = F.col(order).desc() if keep == "last" else F.col(order).asc()
        dim = dim.withColumn("__r", F.row_number().over(Window.partitionBy(k).orderBy(o))) \
            .filter("__r = 1").drop("__r")
    else:
        dim = dim.groupBy(k).agg(*[F.max(c).alias(c) for c in dim.columns if c != k])
    return df.join(F.broadcast(dim), k, "left")


# Sector name normalisation (dataset name -> display name)
# and the set of valid display sectors.
SECTOR_MAP = {
    "Technology": "Technology",
    "Healthcare": "Healthcare",
    "Financial Services": "Financials",
    "Financials": "Financials",
    "Consumer Cyclical": "Consumer Discretionary",
    "Consumer Discretionary": "Consumer Discretionary",
    "Communication Services": "Communication Services",
    "Industrials": "Industrials",
    "Consumer Defensive": "Consumer Staples",
    "Consumer Staples": "Consumer Staples",
    "Energy": "Energy",
    "Utilities": "Utilities",
    "Real Estate": "Real Estate",
    "Basic Materials": "Materials",
    "Materials": "Materials",
}
VALID_SECTORS = [
    "Technology", "Healthcare", "Financials", "Consumer Discretionary",
    "Communication Services", "Industrials", "Consumer Staples",
    "Energy", "Utilities", "Real Estate", "Materials",
]


def normalise_sector(df: DataFrame, col="sector", mapping: dict | None = None,
                     valid: list | None = None) -> DataFrame:
    """Map dataset sector names to display names (unmapped names pass
    through), then drop rows whose sector is not a valid display sector."""
    m = F.create_map(*[F.lit(x) for kv in (mapping or SECTOR_MAP).items() for x in kv])
    mapped = F.coalesce(m[F.col(col)], F.col(col))
    return df.withColumn(col, mapped).filter(F.col(col).isin(list(valid or VALID_SECTORS)))


def with_benchmark(df: DataFrame, ticker="MKT", cols=None, k="ticker", t="dt") -> DataFrame:
    """The benchmark instrument's columns on every row, by date.

    The benchmark side has one row per date, so it is bounded by the
    calendar, not by the data, and is broadcast.
    """
    cols = cols or {"daily_return": "bench_return", "close": "bench_close"}
    bench = df.filter(F.col(k) == ticker).select(F.col(t).alias("__bt"),
                                                 *[F.col(c).alias(a) for c, a in cols.items()])
    return df.join(F.broadcast(bench), F.col(t) == F.col("__bt"), "left").drop("__bt")


def market_return(df: DataFrame, ticker="MKT", ret="daily_return", k="ticker", t="dt") -> DataFrame:
    """C4: benchmark return by date, or the cross-sectional mean return when
    the benchmark has no row on that date."""
    per_date = df.groupBy(t).agg(
        F.max(F.when(F.col(k) == ticker, F.col(ret))).alias("__b"),
        F.max(F.when(F.col(k) == ticker, F.lit(1)).otherwise(F.lit(0))).alias("__has"),
        F.avg(F.when(F.col(k) != ticker, F.col(ret))).alias("__m"))
    per_date = per_date.select(F.col(t).alias("__bt"),
                               F.when(F.col("__has") == 1, F.col("__b")).otherwise(F.col("__m")).alias("bench_return"))
    return df.join(F.broadcast(per_date), F.col(t) == F.col("__bt"), "left").drop("__bt")


def with_group_stat(df: DataFrame, k, agg, name: str) -> DataFrame:
    """A per-key statistic on every row, computed by a window over the
    key (no join, no collect). ``k=None`` gives one scalar over all rows."""
    ws = Window.partitionBy(*([k] if isinstance(k, str) else (k or [])))
    return df.withColumn(name, agg.over(ws))


def enrich(df: DataFrame, feats: DataFrame, on, defaults: dict | None = None) -> DataFrame:
    """Left join on keys then fill defaults."""
    out = df.join(feats, on, "left")
    return out.fillna(defaults) if defaults else out


def with_regime(df: DataFrame, regimes: DataFrame, t="dt", label="regime_label", default="Neutral") -> DataFrame:
    """Exact-date regime lookup (regimes: one row per date, broadcast)."""
    r = regimes.select(F.col(t).alias("__rt"), F.col(label).alias("__rl"))
    return df.join(F.broadcast(r), F.col(t) == F.col("__rt"), "left") \
        .withColumn(label, F.coalesce(F.col("__rl"), F.lit(default))).drop("__rt", "__rl")


def diff_versions(a: DataFrame, b: DataFrame, on, cols) -> DataFrame:
    """C11: rows present on one side only or with a changed value."""
    on = [on] if isinstance(on, str) else list(on)
    aa = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in cols]).withColumn("__a", F.lit(1))
    bb = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in cols]).withColumn("__b", F.lit(1))
    j = aa.join(bb, on, "full_outer")
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    kind = (F.when(F.col("__a").isNull(), F.lit("added")).when(F.col("__b").isNull(), F.lit("removed"))
            .otherwise(F.lit("changed")))
    return j.filter(F.col("__a").isNull() | F.col("__b").isNull() | changed) \
        .withColumn("change", kind).drop("__a", "__b")


def missing_keys(a: DataFrame, b: DataFrame, k) -> DataFrame:
    """Distinct keys of ``a`` absent from ``b``."""
    k = [k] if isinstance(k, str) else list(k)
    return a.select(*k).distinct().join(b.select(*k), k, "left_anti")


def induced_edges(edges: DataFrame, nodes: DataFrame, src="src", dst="dst", id_="ticker") -> DataFrame:
    """Edges whose two endpoints are both in ``nodes``."""
    n = nodes.select(F.col(id_).alias("__n")).distinct()
    e = edges.join(n, F.col(src) == F.col("__n"), "left_semi")
    return e.join(n, F.col(dst) == F.col("__n"), "left_semi")


def valid_symbols(mentions: DataFrame, universe: DataFrame, col="symbol", id_="ticker") -> DataFrame:
    """C20: keep mentioned symbols that exist in the instrument universe."""
    u = universe.select(F.col(id_).alias("__u")).distinct()
    return mentions.join(u, F.col(col) == F.col("__u"), "left_semi")


def month_end(df: DataFrame, k="series_id", t="observation_date") -> DataFrame:
    """Last observation of every (key, year, month)."""
    last = df.groupBy(k, F.year(t).alias("__y"), F.month(t).alias("__m")).agg(F.max(t).alias("__t"))
    return df.join(last, (df[k] == last[k]) & (df[t] == last["__t"]), "left_semi")


def filter_periods(df: DataFrame, t: str, periods: DataFrame, start="start_date", end="end_date",
                   keep=("scenario_id",)) -> DataFrame:
    """Rows inside any named period (range join on a small period table).

    The period table is a fixed parameter list, broadcast; Spark plans a
    broadcast nested-loop range join that never shuffles the fact side.
    """
    p = periods.select(F.col(start).alias("__s"), F.col(end).alias("__e"), *keep)
    return df.join(F.broadcast(p), (F.col(t) >= F.col("__s")) & (F.col(t) <= F.col("__e")), "inner") \
        .drop("__s", "__e")
