"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kairos.llm import simhash as S

SCHEMA = "doc_id long, text string, fingerprint string, key string"


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_small_table(spark):
    rng = np.random.default_rng(5)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    texts += [t + " tail" for t in texts[:6]] + [texts[0], texts[0].upper(), "", None, "  \t\n", "one", "a\x0bb\x0cc d  e"]
    texts += ["x" * 50_000 + " y", "é ü   z"]
    rows = [(i * 7 % 101, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "lonely text here now ok", None, None)]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components([r[0] for r in rows], fps)), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_empty_table(spark):
    df = S.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["doc_id", "fingerprint", "component_id"] and df.count() == 0


def near_set(rng, n, flips):
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    out = set()
    while len(out) < n:
        f = int(rng.choice(base))
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            f ^= 1 << int(b)
        out.add(f)
    return sorted(out)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """Small bucket limits force both levels of splitting."""
    monkeypatch.setattr(S, "BUCKET", 20)
    fps = near_set(np.random.default_rng(1), 300, 9)
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "key long, fp long")
    got = {np.int64(r["fp"]).view(np.uint64): r["root"] for r in S.link_groups(df).collect()}
    comp = brute_components(list(range(len(fps))), fps)
    by = {}
    for f, c in zip(fps, comp):
        by.setdefault(c, []).append(f)
    for group in by.values():
        roots = {got.get(np.uint64(f)) for f in group}
        assert len(roots) == 1
        assert (roots == {None}) == (len(group) == 1)
    assert len({got[np.uint64(g[0])] for g in by.values() if len(g) > 1}) == sum(len(g) > 1 for g in by.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=2, max_size=200), st.integers(1, 130), st.integers(0, 9))
def test_bit_sliced_distance(fps, d, radius):
    f = np.array(fps, np.uint64)
    planes = S.bit_planes(f)
    mask = np.zeros(planes.shape[1] * 64, np.uint8)
    mask[:max(0, len(f) - d)] = 1
    got = S.near_offsets(planes, np.packbits(mask, bitorder="little").view(np.uint64), d, radius)
    want = [i for i in range(len(f) - d) if bin(fps[i] ^ fps[i + d]).count("1") <= radius]
    assert got.tolist() == want


def test_query_matches_brute_force(spark):
    from kairos.llm import catalog
    from llm.conftest import SF_SMALL
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fp(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], zip([f"{f:016x}" for f in fps], brute_components([r["doc_id"] for r in rows], fps))))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.q_simhash(spark, SF_SMALL).collect()}
    assert got == want
