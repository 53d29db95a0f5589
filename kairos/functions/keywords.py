"""Keyword dictionaries of any size by an Aho-Corasick automaton."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship_package

PART = 16 << 20  # characters of keywords in one broadcast automaton


def _parts(keywords: dict[str, list[str]]) -> list[list[tuple[int, str]]]:
    """(entry number, keyword in lower case), in parts of at most PART characters."""
    out, size = [[]], 0
    for i, words in enumerate(keywords.values()):
        for w in words:
            if size + len(w) > PART and out[-1]:
                out.append([])
                size = 0
            out[-1].append((i, w.lower()))
            size += len(w)
    return out


_BUILT: dict = {}


def _automaton(key: str, rows: list[tuple[int, str]]):
    """Built once a worker: keyword -> its length and entries."""
    if key not in _BUILT:
        import ahocorasick
        _BUILT.clear()
        by: dict = {}
        for i, w in rows:
            by.setdefault(w, []).append(i)
        a = ahocorasick.Automaton()
        for w, ids in by.items():
            if w:
                a.add_word(w, (len(w), ids))
        a.make_automaton()
        _BUILT[key] = a, by.get("", [])
    return _BUILT[key]


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def _matcher(shared, key: str, whole_word: bool):
    @arrow_udf("array<int>")
    def match(col: pa.Array) -> pa.Array:
        a, always = _automaton(key, shared.value)
        out = []
        for t in col.to_pylist():
            if t is None:
                out.append(None)
                continue
            hits = set() if whole_word else set(always)
            for end, (size, ids) in a.iter(t) if len(a) else ():
                begin = end - size + 1
                if not whole_word or not ((begin > 0 and _inside(t[begin - 1])) or (end + 1 < len(t) and _inside(t[end + 1]))):
                    hits.update(ids)
            out.append(sorted(hits))
        return pa.array(out, pa.list_(pa.int32()))

    return match


def match_dictionary(spark: SparkSession, text: Column, keywords: dict[str, list[str]], whole_word: bool = False) -> Column:
    """The entries of which a keyword occurs in the text (lower case on both
    sides), in the dictionary's order: one pass over a text for each PART of
    the dictionary, however many keywords it has. ``whole_word`` wants no
    letter, digit or underscore on either side. A null text has null."""
    ship_package(spark)
    names, found = list(keywords), []
    for rows in _parts(keywords):
        shared = spark.sparkContext.broadcast(rows)
        found.append(_matcher(shared, uuid.uuid4().hex, whole_word)(F.lower(text)))
    order = found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))
    return _named(spark, order, names)


def _named(spark: SparkSession, order: Column, names: list[str]) -> Column:
    shared = spark.sparkContext.broadcast(names)

    @arrow_udf("array<string>")
    def name(col: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [shared.value[i] for i in r] for r in col.to_pylist()], pa.list_(pa.string()))

    return name(order)
