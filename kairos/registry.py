"""Registered queries: each is a Spark plan plus (where SQL can express it)
the equivalent DuckDB SQL used as the correctness oracle.

Float columns listed in ``floats`` are rounded half-up to ``digits`` in
both engines, so the oracle compares values, not last-bit summation noise.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship_package


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    floats: tuple = ()
    digits: int = 6
    doc: str = ""
    ops: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, floats=(), digits: int = 6, ops=()):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, tuple(floats), digits, fn.__doc__ or "", tuple(ops))
        return fn
    return deco


def finish(q: Query, df: DataFrame) -> DataFrame:
    if not q.floats:
        return df
    scale = float(10 ** q.digits)
    # round(x * 10^d) / 10^d: the scaled value is the same double in both
    # engines and both round it half away from zero, so results are equal.
    # "+ 0.0" turns a negative zero into 0.0 in both engines.
    return df.withColumns({c: F.round(F.col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0) for c in q.floats})


def oracle_text(q: Query) -> str | None:
    if q.sql is None:
        return None
    if not q.floats:
        return q.sql
    scale = f"{float(10 ** q.digits)!r}e0".replace(".0e0", "e0")
    rep = ", ".join(f"ROUND({c} * {scale}) / {scale} + CAST(0 AS DOUBLE) AS {c}" for c in q.floats)
    return f"SELECT * REPLACE ({rep}) FROM (\n{q.sql}\n) AS oracle_q"


def _load_all():
    # Importing the catalog modules fills REGISTRY.
    for mod in ("catalog_features", "catalog_signals", "catalog_text", "catalog_quality", "catalog_graph", "catalog_decide",
                "catalog_ml", "catalog_docs", "catalog_reports", "catalog_stream", "catalog_sources", "catalog_lines", "catalog_titles"):
        importlib.import_module(f".plans.{mod}", __package__)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    out = {}
    for name, q in REGISTRY.items():
        out[name] = (lambda q: (lambda spark, sf_dir: _run(q, spark, sf_dir)))(q)
    return out


def _run(q: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    # Wall-clock timestamps of the inputs are read as UTC, like the oracle.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return finish(q, q.fn(spark, sf_dir))


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: oracle_text(q) for n, q in REGISTRY.items() if q.sql is not None}
