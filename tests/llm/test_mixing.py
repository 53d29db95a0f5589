"""Mixing against plain water filling, and the SQL oracle."""

import hashlib
import math
from collections import Counter

from kairos.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, target string, w string"


def brute(rows, weights=(1, 2, 3), most=3):
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted([s for s in size if s is not None]) + [None] * (None in size)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(size.values())
    while True:
        left, of = total - sum(most * size[s] for s in full), sum(w[s] for s in order if s not in full)
        share = {s: w[s] * float(left) / float(of) if of else 0.0 for s in order if s not in full}
        more = {s for s, x in share.items() if most * size[s] <= x}
        if not more:
            break
        full |= more
    target = {s: float(most * size[s]) if s in full else share[s] for s in order}
    out = []
    for d, t, s in rows:
        n = len((t or "").split())
        rate = target[s] / size[s] if size[s] else 0.0
        u = int(hashlib.md5(f"{M.SEED}|{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2 ** 52
        out.append((d, n, size[s], target[s], n * (math.floor(rate) + (u < rate - math.floor(rate)))))
    return sorted(out, key=str)


def rows_():
    rows = [(i, "w " * (i % 17 + 1), "s%02d" % (i % 9)) for i in range(300)] + [(1000 + i, "w " * 50, "big") for i in range(100)]
    return rows + [(2000, "a b", "tiny"), (2001, None, "none"), (2002, "", "none"), (2003, "x\t\n y\x0b", None), (None, "q " * 20_000, "long"), (5, "again", "s01"), (5, "again", "s01")]


def test_small_table(spark):
    rows = rows_()
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA).repartition(4)
    got = M.mix_report(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert abs(sum({r["source_size"]: r["target"] for r in got}.values())) > 0 and all(r["taken"] <= 3 * r["size"] for r in got)
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_every_source_full_or_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in M.mix_report(df).collect()] == [(0, 0, 0.0, 0)] * 2
    assert M.mix_report(df.limit(0)).count() == 0 and M.mix(df).count() == 0


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 10, "s%d" % (i % 4)) for i in range(8000)]
    got = M.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    src = {r[0]: r[2] for r in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[src[r["doc_id"]]] += r["taken"]
        target[src[r["doc_id"]]] = r["target"]
    assert abs(sum(target.values()) - 80_000) < 1e-6 and all(abs(taken[s] / t - 1) < 0.05 for s, t in target.items())
