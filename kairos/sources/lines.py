"""Line files as Spark data sources, batch and stream.

``observations`` reads macro series (one JSON document a line, each with its
``observations``), ``broker_csv`` reads broker exports (a header, then one
trade a line). Both cut files into byte ranges; a line belongs to the range
that holds its first byte, so a large file is read by many tasks and a task
holds one chunk and one line. Rows that can't be read whole stay in the result
with their ``problem``, file and byte position, and ``problem_counts`` counts
them: nothing is lost in silence.

The stream form orders files by (change time, name) and its offset is the last
such pair, so a restarted query needs no memory of its own: it reads what came
after its checkpoint. A file is final when it appears (written elsewhere and
renamed, as Spark does); ``settleSeconds`` holds files back until they are that
old, for storage whose change times are coarse (default 2).
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import sys
import time
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# The processes that plan a stream don't see shipped packages: the classes
# below travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20  # bytes read at once
RANGE = 64 << 20  # bytes of a file in one partition, unless rangeBytes says otherwise
ROWS = 8192  # rows in one Arrow batch


@dataclass
class Span(InputPartition):
    """The lines of ``path`` that begin in [start, end)."""

    path: str
    start: int
    end: int


def _filesystem(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[int, str, int]]:
    """(change time in ns, path, bytes) of the data files below ``path``."""
    system, root = _filesystem(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        found = [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
    kept = [f for f in found if not any(p.startswith(("_", ".")) for p in f.path[len(root):].split("/")) and f.size]
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in kept)


def _spans(files, size: int) -> list[Span]:
    return [Span(path, a, min(a + size, total)) for _, path, total in files for a in range(0, total, size)]


def _lines(stream, span: Span):
    """(byte position, line) of the lines that begin in the span."""
    at = max(span.start - 1, 0)
    stream.seek(at)
    held, skip = b"", span.start > 0
    while True:
        chunk = stream.read(CHUNK)
        *whole, rest = (held + chunk).split(b"\n") if chunk else [*([held] if held else []), b""]
        for line in whole:
            if skip:  # the line that begins before the span, or its end mark
                skip = False
            elif at >= span.end:
                return
            else:
                yield at, line
            at += len(line) + 1
        held = rest
        if not chunk or (not skip and at >= span.end):
            return


def _open(source: "LineSource", path: str):
    return _filesystem(source.options["path"])[0].open_input_file(path)


def _batches(source: "LineSource", span: Span):
    schema = source.arrow
    with _open(source, span.path) as stream:
        head = source.header(stream)
        rows = []
        for at, line in _lines(stream, span):
            if at == 0 and head is not None:
                if head.problem:
                    rows.append((*source.nothing, head.problem, span.path, at))
                continue
            text = line.decode("utf-8", "replace")
            if not text.strip():
                continue
            for row in source.parse(text, head):
                rows.append((*row, span.path, at))
                if len(rows) == ROWS:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, source):
        self.source = source

    def partitions(self):
        return _spans(_files(self.source.options["path"]), self.source.range_bytes)

    def read(self, partition):
        if partition is not None:  # no file at all
            yield from _batches(self.source, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source):
        self.source = source
        self.settle = int(float(source.options.get("settleSeconds", "2")) * 1e9)

    def initialOffset(self):
        return {"time": -1, "path": ""}

    def latestOffset(self):
        old = time.time_ns() - self.settle
        done = [f for f in _files(self.source.options["path"]) if f[0] <= old]
        return {"time": done[-1][0], "path": done[-1][1]} if done else self.initialOffset()

    def partitions(self, start, end):
        a, b = (start["time"], start["path"]), (end["time"], end["path"])
        return _spans([f for f in _files(self.source.options["path"]) if a < f[:2] <= b], self.source.range_bytes)

    def read(self, partition):
        yield from _batches(self.source, partition)

    def commit(self, end):
        pass


class LineSource(DataSource):
    """A format of lines: ``fields`` (DDL) plus problem, file and position."""

    fields = ""

    @property
    def range_bytes(self) -> int:
        return max(1, int(self.options.get("rangeBytes", RANGE)))

    @property
    def nothing(self) -> tuple:
        return (None,) * (len(self.arrow) - 3)

    @property
    def arrow(self) -> pa.Schema:
        return self._arrow

    def schema(self):
        return f"{self.fields}, problem string, file string, position long"

    def header(self, stream):
        """What the first line says, or None for a format without header."""
        return None

    def parse(self, text: str, head):
        """Rows of one line, the problem (or None) last."""
        raise NotImplementedError

    def reader(self, schema):
        return _Reader(self)

    def streamReader(self, schema):
        return _StreamReader(self)


def _day(text) -> dt.date | None:
    if isinstance(text, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError:
            return None
    return None


class Observations(LineSource):
    """Macro series: ``{"series_id": ..., "observations": [{"date", "value"}]}``.

    "." and "" are missing values; any other value that is no number is null
    with the problem ``value``, a bad date null with ``date``, both with
    ``date,value``. A line that is no such document is one row of nulls with
    ``document``; a document without observations has no rows.
    """

    fields = "series_id string, observation_date date, value double"
    _arrow = pa.schema([("series_id", pa.string()), ("observation_date", pa.date32()), ("value", pa.float64()),
                        ("problem", pa.string()), ("file", pa.string()), ("position", pa.int64())])

    @classmethod
    def name(cls):
        return "observations"

    def parse(self, text, head):
        try:
            doc = json.loads(text)
            items = doc.get("observations") or []
            series = doc.get("series_id")
            if not all(isinstance(o, dict) for o in items):
                raise ValueError
        except (ValueError, AttributeError, TypeError, RecursionError):
            yield None, None, None, "document"
            return
        for o in items:
            raw, date = o.get("value", "."), _day(o.get("date"))
            value, bad = None, ["date"] if date is None else []
            if raw is not None and raw not in (".", ""):
                try:
                    value = float(raw)
                except (ValueError, TypeError, OverflowError):
                    bad.append("value")
            yield None if series is None else str(series), date, value, ",".join(bad) or None


@dataclass
class Header:
    columns: dict
    problem: str | None = None


# Parts of a header cell that name a broker column.
BROKER_COLUMNS = {"ticker": ("symbol", "ticker"), "action": ("action", "side", "type"), "date": ("date", "time"),
                  "profit": ("profit", "pnl", "p&l"), "notes": ("note", "comment")}
NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


class BrokerCsv(LineSource):
    """Broker exports: columns found by parts of the header's names.

    A row without a ticker, or with one of more than five characters, is no
    trade: null fields but the ticker, problem ``ticker``. A profit is the number
    at the start of its field, else 0 with the problem ``profit`` (also if other
    text follows the number). An empty action is BUY, empty notes become
    "<action> <ticker>". A file whose header names none of symbol, ticker and
    action gives one row with the problem ``header``, and its lines the same.
    """

    fields = "ticker string, action string, date string, profit double, notes string"
    _arrow = pa.schema([("ticker", pa.string()), ("action", pa.string()), ("date", pa.string()), ("profit", pa.float64()),
                        ("notes", pa.string()), ("problem", pa.string()), ("file", pa.string()), ("position", pa.int64())])

    @classmethod
    def name(cls):
        return "broker_csv"

    def header(self, stream):
        stream.seek(0)
        first = b""
        while b"\n" not in first:
            chunk = stream.read(4096)
            if not chunk:
                break
            first += chunk
        line = first.split(b"\n")[0].decode("utf-8-sig", "replace").lower()
        cells = [c.strip() for c in line.split(",")]
        at = {k: next((i for i, c in enumerate(cells) if any(p in c for p in parts)), None) for k, parts in BROKER_COLUMNS.items()}
        known = any(w in line for w in ("symbol", "ticker", "action"))
        return Header(at, None if known else "header")

    def parse(self, text, head):
        if head.problem:
            yield (*self.nothing, head.problem)
            return
        cells = [c.strip() for c in text.split(",")]

        def cell(name):
            i = head.columns[name]
            return cells[i] if i is not None and i < len(cells) else ""

        ticker = cell("ticker").upper()
        if not ticker or len(ticker) > 5:
            yield ticker or None, None, None, None, None, "ticker"
            return
        action = cell("action").upper() or "BUY"
        raw = cell("profit")
        found = NUMBER.match(raw)
        profit = float(found.group(1)) if found else 0.0
        if not math.isfinite(profit):
            profit, found = 0.0, None
        clean = not raw or (found is not None and found.end() == len(raw))
        yield ticker, action, cell("date"), profit, cell("notes") or f"{action} {ticker}", None if clean else "profit"


def _register(spark: SparkSession) -> None:
    for source in (Observations, BrokerCsv):
        spark.dataSource.register(source)


def read_lines(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """All rows of the files below ``path`` (``kind``: observations or
    broker_csv), those with a problem too. No file: no rows."""
    _register(spark)
    return spark.read.format(kind).options(path=path, **options).load()


def stream_lines(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """The same rows as a stream over files that arrive below ``path``."""
    _register(spark)
    return spark.readStream.format(kind).options(path=path, **options).load()


def macro_rows(lines: DataFrame) -> DataFrame:
    """The observations; bad dates and values are null."""
    return lines.filter(~F.col("problem").eqNullSafe("document")).select("series_id", "observation_date", "value")


def trade_rows(lines: DataFrame) -> DataFrame:
    """The trades; rows without a usable ticker are left out."""
    return lines.filter(F.coalesce(~F.col("problem").isin("ticker", "header"), F.lit(True))).select("ticker", "action", "date", "profit", "notes")


def problem_counts(lines: DataFrame) -> DataFrame:
    """Rows by problem (null: read whole)."""
    return lines.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def stream_schema(kind: str) -> T.StructType:
    return T.StructType.fromDDL({"observations": Observations, "broker_csv": BrokerCsv}[kind]({}).schema())
