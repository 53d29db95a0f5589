"""Merkle manifest against a plain recursion over lists."""

import hashlib
import zlib

import pytest

from kairos.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else "%d:%s" % (len(str(v).encode()), v)


def leaf(doc, text, lang, source, n):
    return sha("".join(map(enc, (doc, source, lang, n, text))))


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def climb(nodes):
    """Root and, for each node, its (left, right) siblings upwards."""
    paths = [[] for _ in nodes]
    member = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, holds = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i:i + 16]
            for j in range(len(run)):
                for m in member[i + j]:
                    paths[m].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha("".join(run)))
            holds.append(sum(member[i:i + 16], []))
        nodes, member = up, holds
    return nodes[0], paths


def brute(rows):
    if not rows:
        return []
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        rs = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((rs, *climb([leaf(*r) for r in rs])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (rs, subroot, paths), top in zip(trees, tops):
        for r, path in zip(rs, paths):
            cur = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                cur = leaf(r[0], lower(r[1]), *r[2:])
            for a, b in path + top:
                cur = sha(a + cur + b)
            out.append((r[0], leaf(*r), subroot, root, sha("".join(a + b for a, b in path + top)), cur, cur == root))
    return out


def check(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("key", "rank", "n", "digest", "leaf", "path", "root", "part", "at"):
            df = df.withColumn(c, df.lang)
    got = [tuple(r) for r in M.report(df.repartition(3)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def test_trees(spark):
    """Sources of 1, 15, 16, 17, 257 and 300 rows, null and odd sources."""
    sizes = {"a": 1, "b": 15, "ä": 16, "Z": 17, None: 257, "": 300, "s|1": 2}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i * 37 % 1009, None if i % 11 == 0 else "Text É %d " % i * (i % 5), None if i % 7 == 0 else "en", s, None if i % 13 == 0 else i))
            i += 1
    want = check(spark, rows, extra=True)
    assert {w[6] for w in want} == {True, False}


def test_odd_rows(spark):
    same = (3, "Same", "en", "x", 4)
    check(spark, [same] * 40 + [(3, "Other", "en", "x", 5), (None, "No id", None, "x", None), (None, None, None, None, None), (None, None, None, None, None)])


def test_small_tables(spark):
    check(spark, [(15, "ABC", "en", "x", 3)])
    check(spark, [(1, "X" * 100_000, "en", None, 3), (2, "", "", "", 0)])
    assert M.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources(spark):
    check(spark, [(i, "T%d" % i, "en", "src%d" % (i % 40), 2) for i in range(90)])


def test_records_answer_by_digest(spark):
    """Each record's key is the digest of its children."""
    rows = spark.createDataFrame([(i, "x", str(i)) for i in range(300)], "doc_id long, source string, leaf string")
    below, above = M.manifest(rows, ("doc_id",))
    assert len(below.levels) == 3 and not above.levels
    for h in (1, 2, 3):
        for r in below.records(h).collect():
            assert r.digest == sha("".join(r.children)) and len(r.children) <= 16


@pytest.fixture
def broadcasts(spark, monkeypatch):
    """The names of the staged tables whose plan has a broadcast, at a threshold of 32 MB."""
    old, found, stage = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], M.stage
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 << 20))
    monkeypatch.setattr(M, "stage", lambda df, name: (found.extend([name] * ("Broadcast" in plan(df))), stage(df, name))[1])
    yield found
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_requests_are_not_broadcast(spark, broadcasts):
    """Requests and records of every level meet without the driver, whatever Spark estimates: one large source, and many of one and two rows."""
    for source in (lambda i: "s", lambda i: "s%d" % (i * 2 // 3)):
        rows = [(i, "T%d" % i, "en", source(i), 2) for i in range(600)]
        out = M.report(spark.createDataFrame(rows, SCHEMA))
        assert "Broadcast" not in plan(out)
        out.collect()
        assert "Broadcast" not in plan(out)
        check(spark, rows)
    assert "requests" not in broadcasts


def test_offsets_are_broadcast_if_few(spark, broadcasts, monkeypatch):
    """Offsets of many partitions, or of few with long keys, are joined by shuffle, with the same ranks."""
    rows = [(i, "T%d" % i, "en", "s%d" % (i % 40), 2) for i in range(400)]
    check(spark, rows)
    assert "leaf-ranks" in broadcasts
    broadcasts.clear()
    check(spark, [(*r[:3], r[3] * 50_000, r[4]) for r in rows])
    monkeypatch.setattr(M, "FEW", 0)
    check(spark, rows)
    assert "leaf-ranks" not in broadcasts
