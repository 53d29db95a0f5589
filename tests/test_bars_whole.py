"""Bars of hand-made trades: repeated and missing keys, and no sort of all trades, also not for the join of suppliers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kairos import session
from kairos.plans import fixtures as FX

DAY = dt.datetime(2024, 1, 2, 9)
TRADES = [  # order, line, part, supplier, price, quantity, time
    (5, 1, 1, 1, 100.0, 10.0, DAY), (2, 2, 9, 1, 60.0, 3.0, DAY), (2, 1, 7, 1, 80.0, 8.0, DAY), (2, 1, 7, 1, 80.0, 8.0, DAY),
    (9, 1, 1, 1, 50.0, 1.0, DAY), (9, 1, 1, 2, 90.0, 2.0, DAY), (9, 1, None, 2, 40.0, 1.0, DAY), (None, 3, 1, 3, 30.0, 2.0, DAY),
    (None, 4, 1, 3, 33.0, 3.0, DAY), (None, None, 1, 2, 7.0, 0.0, DAY), (1, 1, 1, None, 99.0, 1.0, DAY), (1, 1, 1, 4, 99.0, 1.0, DAY),
    (1, 1, 1, 5, 99.0, 1.0, DAY), (3, 1, 1, 1, 20.0, 5.0, None), (4, 1, 1, 1, 21.0, 3.0, None)]
SUPPLIERS = [(1, 1), (2, 2), (2, 2), (3, 3), (4, None), (5, 99)]  # one twice, one without and one with an unknown nation
NATIONS = [(1, "A", 1), (2, "B", 1), (3, "A", 2)]  # two nations of one name


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("lineitem", TRADES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp")
    put("supplier", SUPPLIERS, "s_suppkey long, s_nationkey int")
    put("nation", NATIONS, "n_nationkey int, n_name string, n_regionkey int")
    put("region", [(1, "X"), (2, "Y")], "r_regionkey int, r_name string")
    return str(tmp_path)


def brute():
    names, regions = {k: (n, r) for k, n, r in NATIONS}, {1: "X", 2: "Y"}
    groups = {}
    for t in TRADES:
        for nation in (n for s, n in SUPPLIERS if s == t[3] and n in names):
            name, region = names[nation]
            day = t[6] and t[6].date()
            for key in ((name, day), ("MKT", day)):
                groups.setdefault(key, []).append((t, regions[region] if key[0] != "MKT" else None))
    out = set()
    for (name, day), rows in groups.items():
        rows.sort(key=lambda r: [(v is not None, v or 0) for v in r[0][:5]])
        px = [t[4] / t[5] if t[5] else None for t, _ in rows]
        seen = [p for p in px if p is not None]
        out.add((name, max((s for _, s in rows if s), default=None), day, px[0], max(seen), min(seen), px[-1], int(sum(t[5] for t, _ in rows))))
    return out


def test_bars_of_repeated_and_missing_keys(spark, folder):
    assert {tuple(r) for r in FX.bars(spark, folder).collect()} == brute()


def test_trades_are_aggregated_by_hash(spark, folder, monkeypatch):
    plans = []
    kept = session.layer_table

    def layer(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(session, "layer_table", layer)
    last = FX.bars(spark, folder)
    assert len(plans) == 1 and "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]
    # What is compared by the whole trade key are trades of the days' end orders.
    assert "LeftSemi" in last._jdf.queryExecution().sparkPlan().toString() and last.filter(F.col("ticker") == "MKT").count() == 2


@pytest.mark.parametrize("most, join", [(FX.BROADCAST_SUPPLIERS, "BroadcastHashJoin"), (0, "ShuffledHashJoin")])
def test_trades_are_not_sorted_for_the_join_of_suppliers(spark, folder, monkeypatch, most, join):
    plans = []
    kept = session.layer_table

    def layer(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(session, "layer_table", layer)
    monkeypatch.setattr(FX, "BROADCAST_SUPPLIERS", most)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # more suppliers than the planner would broadcast
    try:
        last = FX.bars(spark, folder)
        plans.append(last._jdf.queryExecution().sparkPlan().toString())
        assert {tuple(r) for r in last.collect()} == brute()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for plan in plans:
        sides = [line for line in plan.splitlines() if "Join [l_suppkey" in line]
        assert sides and all(join in line for line in sides)
