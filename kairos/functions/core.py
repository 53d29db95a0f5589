"""Scalar column helpers (B1, B4, B14, L12-L14, safe arithmetic).

All helpers build JVM-side expressions: nothing here is a Python UDF.
Spark runs with ANSI on, so every division goes through ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["col_", "div", "flag", "finite_or", "lerp", "safe_corr", "stable_uniform",
           "round_cols", "pct_change", "clip"]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """Null-safe division: null when the divisor is 0 or null."""
    return F.try_divide(col_(a), col_(b))


def pct_change(cur, prev) -> Column:
    return div(col_(cur) - col_(prev), prev)


def flag(cond: Column) -> Column:
    """B1: a threshold flag that is never null (null condition -> False)."""
    return F.coalesce(cond, F.lit(False))


def finite_or(c, default: float = 0.0) -> Column:
    """Replace null, NaN and +-Inf by ``default``."""
    c = col_(c)
    return (F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(default))
            .otherwise(c))


def lerp(t, lo: float, hi: float) -> Column:
    """Linear interpolation lo + t * (hi - lo)."""
    return F.lit(lo) + col_(t) * F.lit(hi - lo)


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col_(c), F.lit(lo)), F.lit(hi))


def safe_corr(x, y, over=None) -> Column:
    """Pearson correlation over pairwise-complete rows; null when a side is
    constant (``corr`` raises DIVIDE_BY_ZERO under ANSI in that case).
    ``over``: a window spec, applied to each of the three aggregates."""
    x, y = col_(x), col_(y)
    xx = F.when(y.isNotNull(), x)
    yy = F.when(x.isNotNull(), y)
    aggs = [F.covar_pop(xx, yy), F.stddev_pop(xx), F.stddev_pop(yy)]
    if over is not None:
        aggs = [a.over(over) for a in aggs]
    return F.try_divide(aggs[0], aggs[1] * aggs[2])


def stable_uniform(*cols) -> Column:
    """A deterministic uniform number in [0, 1) from the given columns.

    First 8 hex digits of md5 over the '|'-joined text, divided by 2^32.
    The same expression exists in DuckDB, so sampling operators keep an
    exact SQL oracle. Replaces the seeded generators of the source.
    """
    txt = F.concat_ws("|", *[col_(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def round_cols(df, spec: dict[str, int]):
    """Round listed columns half-up to fixed digits."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in spec.items()})
