"""Line sources: byte ranges, bad rows, streams that go on."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kairos.sources import lines as L
from kairos.streaming import jobs as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


def series(i, n):
    return json.dumps({"series_id": f"S{i}", "observations": [{"date": f"2024-01-{d:02d}", "value": str(d + i / 7)} for d in range(1, n + 1)]})


@pytest.mark.parametrize("size", [1, 7, 64, 100000])
@pytest.mark.parametrize("end", ["", "\n", "\r\n", "\n\n\n"])
def test_every_line_is_in_one_range(tmp_path, size, end):
    rnd = random.Random(size)
    text = "\n".join("x" * rnd.randint(0, 40) for _ in range(60)) + end
    put(tmp_path, "a.json", text)
    src = L.Observations({"path": str(tmp_path), "rangeBytes": str(size)})
    got = []
    for span in src.reader(None).partitions():
        with L._open(src, span.path) as stream:
            got += list(L._lines(stream, span))
    want, at = [], 0
    for line in text.encode().split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    assert [x for x in got if x[1]] == [x for x in want if x[1]]
    assert len({a for a, _ in got}) == len(got)


def test_chunks_do_not_matter(tmp_path, monkeypatch):
    put(tmp_path, "a.json", "\n".join(series(i, 1 + i % 28) for i in range(40)))
    src = L.Observations({"path": str(tmp_path), "rangeBytes": "500"})
    read = lambda: [b.to_pylist() for s in src.reader(None).partitions() for b in L._batches(src, s)]
    want = read()
    for chunk in (1, 3, 64, 499):
        monkeypatch.setattr(L, "CHUNK", chunk)
        assert read() == want


def test_observations(spark, tmp_path):
    d = str(tmp_path / "m")
    doc = {"series_id": "A", "observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-01-02", "value": "."}, {"date": "2024-01-03", "value": ""},
                                              {"date": "2024-01-04", "value": "n/a"}, {"date": "soon", "value": "2"}, {"date": "2024-02-30"},
                                              {"date": "no", "value": "no"}, {"value": None, "date": "2024-01-05"}, {"date": "2024-01-06", "value": 7}]}
    put(d, "a.json", json.dumps(doc) + "\n{broken\n[1]\n\n" + json.dumps({"series_id": None}) + "\n" + json.dumps({"observations": [3]}))
    put(d, "_SUCCESS", "no data")
    put(d, "empty.json", "")
    for size in ("9", "1000000"):
        got = L.read_lines(spark, d, "observations", rangeBytes=size)
        day = lambda n: dt.date(2024, 1, n)
        assert rows(L.macro_rows(got)) == sorted([("A", day(1), 1.5), ("A", day(2), None), ("A", day(3), None), ("A", day(4), None), ("A", None, 2.0),
                                                  ("A", None, None), ("A", None, None), ("A", day(5), None), ("A", day(6), 7.0)], key=repr)
        assert dict(rows(L.problem_counts(got))) == {None: 5, "value": 1, "date": 2, "date,value": 1, "document": 3}


def test_positions_lead_back_to_the_line(spark, tmp_path):
    d = str(tmp_path / "p")
    text = series(1, 3) + "\n{bad\n" + series(2, 2) + "\n"
    put(d, "a.json", text)
    bad = L.read_lines(spark, d, "observations", rangeBytes="20").filter(F.col("problem").isNotNull()).collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("a.json") and text.encode()[bad[0]["position"]:].startswith(b"{bad")


def test_broker(spark, tmp_path):
    d = str(tmp_path / "b")
    put(d, "x.csv", "﻿Date/Time,Symbol,Side,P&L,Comment\n2024-01-02,aapl,sell,12.5USD,took it\n2024-01-03,TOOLONG,buy,1,\n,msft,,-3,\n"
                    "2024-01-04,,buy,1,x\n2024-01-05,ibm,buy,none,\nx,f\n")
    put(d, "other.csv", "a,b\n1,2\n")
    for size in ("5", "100000"):
        got = L.read_lines(spark, d, "broker_csv", rangeBytes=size)
        assert rows(L.trade_rows(got)) == sorted([("AAPL", "SELL", "2024-01-02", 12.5, "took it"), ("MSFT", "BUY", "", -3.0, "BUY MSFT"),
                                                  ("IBM", "BUY", "2024-01-05", 0.0, "BUY IBM"), ("F", "BUY", "x", 0.0, "BUY F")], key=repr)
        assert dict(rows(L.problem_counts(got))) == {None: 2, "profit": 2, "ticker": 2, "header": 2}


def test_empty_folder(spark, tmp_path):
    d = str(tmp_path / "none")
    os.makedirs(d)
    assert L.read_lines(spark, d, "observations").count() == 0


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound"):
        L.read_lines(spark, str(tmp_path / "nowhere"), "observations").count()


def test_stream_goes_on_with_new_files(spark, tmp_path):
    d = str(tmp_path / "s")
    out = S.shared_path(spark, "lines")
    put(d, "b.json", series(1, 5) + "\n" + series(2, 4))

    def drain():
        st = L.stream_lines(spark, d, "observations", settleSeconds="0", rangeBytes="50")
        return rows(L.macro_rows(S.run_batches(st, out, schema=L.stream_schema("observations"))))
    assert len(drain()) == 9 and len(drain()) == 9
    put(d, "a.json", series(3, 6))
    whole = rows(L.macro_rows(L.read_lines(spark, d, "observations")))
    assert drain() == whole and len(whole) == 15 and drain() == whole
