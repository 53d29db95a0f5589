"""Rules observed in the writing pass equal the scans of the written table."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from conftest import SF_SMALL
from kairos.operators import observed as O
from kairos.operators import quality as M
from kairos.plans.gold import signal_table
from kairos.plans.silver import silver_path, silver_table
from kairos.sources import storage

BARS = "ticker string, sector string, dt date, close double, volume bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def bars(spark, data):
    return spark.createDataFrame(data, BARS).withColumn("dt", F.col("dt").cast("date"))


def dirty(spark):
    import datetime as dt
    d = [dt.date(2024, 1, n) for n in range(1, 6)]
    return bars(spark, [("A", "x", d[0], 1.0, 5), ("A", "x", d[0], 2.0, 5), ("A", "y", d[0], 2.0, 5), ("A", None, d[1], -1.0, -5), ("B", "z", None, None, None),
                        ("B", "z", None, 1.0, 1), (None, "z", d[2], 1.0, 1), (None, "z", d[2], 1.0, 1), (None, None, None, 3.0, 0), ("C", "x", d[4], 0.0, 2)])


def test_bar_rules_equal_the_scan(spark):
    t = dirty(spark).repartition(5, "close")
    path = O.layer_path(spark, "t")
    O.write_observed(t, path, {"bronze": O.bronze_rules(5, 2, 3)})
    assert rows(O.read_checks(spark, path)) == rows(M.bronze_checks(t, 5, 2, 3))
    assert rows(spark.read.parquet(path).select(*[F.col(c).cast("string") for c in t.columns]).fillna("-")) == \
        rows(t.select(*[F.col(c).cast("string") for c in t.columns]).fillna("-"))


def test_layers_equal_their_scans(spark):
    path, s = silver_path(spark, SF_SMALL), silver_table(spark, SF_SMALL)
    assert {c for c in rows(O.read_checks(spark, path)) if c[0] == "silver"} == set(rows(M.silver_checks(s)))
    g = signal_table(s)
    gold = O.layer_path(spark, "g")
    report = O.write_observed(g, gold, {"gold": O.gold_rules()})
    assert rows(O.read_checks(spark, gold)) == rows(M.gold_checks(g))
    assert rows(O.read_status(spark, path, gold)) == rows(M.quality_report(O.read_checks(spark, path, gold)).select("layer", "total_checks", "failed_checks", "status"))
    assert json.loads(storage.read_text(spark, f"{gold}-report.json")) == report


def test_empty_table(spark):
    path = O.layer_path(spark, "e")
    report = O.write_observed(dirty(spark).limit(0), path, {"bronze": O.bronze_rules(), "gone": [O.Rule("mean", F.avg("close"), "", lambda v: True)]})
    by = {(c["layer"], c["name"]): c for c in report["checks"]}
    assert by["bronze", "row_count"]["value"] == 0 and not by["bronze", "row_count"]["passed"]
    assert by["bronze", "sector_count"]["value"] == 0 and by["bronze", "duplicate_ticker_dates"]["passed"]
    assert by["gone", "mean"]["value"] is None and not by["gone", "mean"]["passed"]


def test_one_scan_and_no_second_exchange_by_key(spark):
    path = O.layer_path(spark, "one")
    dirty(spark).write.parquet(path)
    t = spark.read.parquet(path).repartition(4, "ticker")
    out, _ = O.observe_rules(t, {"bronze": O.bronze_rules()})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 1
    assert plan.count("Exchange hashpartitioning") == 1


RETRY = """
import sys
sys.path[:0] = [ROOT, ROOT + "/tests"]
from pyspark import TaskContext
from kairos.operators import observed as O
from kairos.session import get_spark
from test_observed import dirty
spark = get_spark("local[2,3]", shuffle_partitions=4)

def fail_once(it):
    yield from it
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

out, seen = O.observe_rules(dirty(spark), {"bronze": O.bronze_rules()})
out.mapInPandas(fail_once, out.schema).write.format("noop").mode("overwrite").save()
print("ROWS", seen.get["bronze:row_count"], seen.get["bronze:distinct_tickers"], seen.get["bronze:duplicate_ticker_dates"])
"""


def test_lost_tasks_are_counted_once():
    """Tasks that fail after their rows were seen run again and count once (in
    a session of its own: local mode tries a task once unless told otherwise)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", f"ROOT = {root!r}\n{RETRY}"], capture_output=True, text=True, timeout=200)
    assert "ROWS 10.0 3.0 3.0" in done.stdout, done.stdout + done.stderr[-3000:]
