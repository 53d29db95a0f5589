"""Quality rules measured while a table is written (M1-M4, M6, M8).

``write_observed`` adds the rules' aggregates to the writing job by
``DataFrame.observe``: the rows are counted on their way into the files and no
second scan is planned. The report document, JSON, lies beside the table.

Observed metrics can't hold distinct aggregates. Keys are counted by marks that a
window sets in the same pass: the first row of a ``key`` value and the second
row of a (key, time) pair. If the table already comes by key, no exchange is
added. Values of small dimensions (``dims``) are gathered as sets, so a
dimension must have few values.

The metrics belong to the job's last stage, whose tasks Spark counts once each,
also when tasks or executors are lost and run again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import storage
from .quality import SILVER_FEATURES

FIRST, AGAIN = "__first_of_key", "__second_of_pair"
REPORT = "array<struct<layer:string,name:string,value:double,threshold:string,passed:boolean>>"


@dataclass(frozen=True)
class Rule:
    """``value`` is an aggregate without distinct; ``passed`` judges its number."""

    name: str
    value: Column
    threshold: str
    passed: Callable[[float], bool]


def _zero(v: float) -> bool:
    return v == 0


def _rows() -> Column:
    return F.count(F.lit(1))


def keys() -> Column:
    return F.count_if(F.col(FIRST))


def repeated_pairs() -> Column:
    return F.count_if(F.col(AGAIN))


def values_of(dim: str) -> Column:
    return F.size(F.collect_set(dim))


def bronze_rules(min_rows=100000, min_tickers=400, min_sectors=8) -> list[Rule]:
    """M2, as ``quality.bronze_checks`` has them."""
    nulls = [Rule(f"null_{c}", F.count_if(F.col(c).isNull()), "0", _zero) for c in ("ticker", "dt", "close", "volume")]
    return [Rule("row_count", _rows(), f">{min_rows}", lambda v: v > min_rows), Rule("distinct_tickers", keys(), f">{min_tickers}", lambda v: v > min_tickers),
            *nulls, Rule("negative_prices", F.count_if(F.col("close") < 0), "0", _zero), Rule("negative_volumes", F.count_if(F.col("volume") < 0), "0", _zero),
            Rule("duplicate_ticker_dates", repeated_pairs(), "0", _zero), Rule("sector_count", values_of("sector"), f">={min_sectors}", lambda v: v >= min_sectors)]


def silver_rules(min_rows=100000, max_null_pct=10.0) -> list[Rule]:
    """M3, as ``quality.silver_checks`` has them."""
    nulls = [Rule(f"null_pct_{name}", F.count_if(F.col(c).isNull()) * 100.0 / _rows(), f"<{max_null_pct}", lambda v: v < max_null_pct)
             for name, c in SILVER_FEATURES.items()]
    return [Rule("row_count", _rows(), f">{min_rows}", lambda v: v > min_rows), *nulls,
            Rule("rsi_range", F.count_if((F.col("rsi_14") < 0) | (F.col("rsi_14") > 100)), "0", _zero),
            Rule("negative_volatility", F.count_if(F.col("realized_vol_20d") < 0), "0", _zero),
            Rule("latest_date_days", F.datediff(F.max("dt"), F.lit("1970-01-01")), "", lambda v: True)]


def gold_rules(min_tickers=400, min_sectors=8) -> list[Rule]:
    """M4, as ``quality.gold_checks`` has them."""
    return [Rule("ticker_count", keys(), f">{min_tickers}", lambda v: v > min_tickers),
            Rule("top_tier_pct", F.count_if(F.col("top_tier")) * 100.0 / _rows(), "(0,10)", lambda v: 0 < v < 10),
            Rule("null_score", F.count_if(F.col("signal_score").isNull()), "0", _zero),
            Rule("score_range", F.count_if((F.col("signal_score") < 0) | (F.col("signal_score") > 5)), "0", _zero),
            Rule("sector_count", values_of("sector"), f">={min_sectors}", lambda v: v >= min_sectors)]


def marked(df: DataFrame, key: str = "ticker", time: str = "dt") -> DataFrame:
    """Marks the first row of each key (a null key has none) and the second
    row of each (key, time) pair, nulls being values of a pair."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(time)) == 1
    again = F.row_number().over(Window.partitionBy(key, time).orderBy(time)) == 2
    return df.withColumns({FIRST: first & F.col(key).isNotNull(), AGAIN: again})


def observe_rules(df: DataFrame, rules: dict[str, list[Rule]], key: str = "ticker", time: str = "dt") -> tuple[DataFrame, Observation]:
    """``df`` with the rules of each layer as observed metrics."""
    seen = Observation(f"rules-{uuid.uuid4().hex}")
    metrics = [r.value.cast("double").alias(f"{layer}:{r.name}") for layer, rs in rules.items() for r in rs]
    return marked(df, key, time).observe(seen, *metrics).select(*[F.col(f"`{c}`") for c in df.columns]), seen


def report_document(values: dict, rules: dict[str, list[Rule]]) -> dict:
    """Checks with their verdicts, and the status of each layer. A rule without
    a value (an empty table) has not passed."""
    checks = [{"layer": layer, "name": r.name, "value": v, "threshold": r.threshold, "passed": v is not None and bool(r.passed(v))}
              for layer, rs in rules.items() for r in rs for v in [values.get(f"{layer}:{r.name}")]]
    layers = []
    for layer in rules:
        failed = sum(not c["passed"] for c in checks if c["layer"] == layer)
        layers.append({"layer": layer, "total_checks": len(rules[layer]), "failed_checks": failed, "status": "fail" if failed else "pass"})
    return {"checks": checks, "layers": layers}


def write_observed(df: DataFrame, path: str, rules: dict[str, list[Rule]], key: str = "ticker", time: str = "dt") -> dict:
    """Write ``df`` as Parquet at ``path`` and its report at
    ``path``-report.json; returns the report."""
    out, seen = observe_rules(df, rules, key, time)
    out.write.parquet(path)
    report = report_document(seen.get, rules)
    storage.write_text(df.sparkSession, f"{path}-report.json", json.dumps(report))
    return report


def layer_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/layers/{name}-{uuid.uuid4().hex}"


def read_checks(spark: SparkSession, *paths: str) -> DataFrame:
    """The checks of the reports beside the tables at ``paths``."""
    docs = spark.read.schema(f"checks {REPORT}").json([f"{p}-report.json" for p in paths])
    return docs.select(F.inline("checks"))


def read_status(spark: SparkSession, *paths: str) -> DataFrame:
    """The layers of the reports beside the tables at ``paths``."""
    kind = "array<struct<layer:string,total_checks:bigint,failed_checks:bigint,status:string>>"
    docs = spark.read.schema(f"layers {kind}").json([f"{p}-report.json" for p in paths])
    return docs.select(F.inline("layers"))
