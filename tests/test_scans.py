"""Affine scans and blocked correlations against plain loops."""

import numpy as np
import pandas as pd
import pytest

from kairos.operators import graph as G
from kairos.operators import windows as E


@pytest.mark.parametrize("block", [4, 64])
def test_exponential_means(spark, block):
    rng = np.random.default_rng(1)
    rows = [(k, i, None if (i + len(k)) % 11 == 0 or (k == "ccc" and i < 9) else float(rng.normal() * 10)) for k, n in (("a", 400), ("bb", 1), ("ccc", 37)) for i in range(n)]
    rows += [("null", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "ticker string, dt int, x double").repartition(5)
    got = E.ema_columns(df, [("e2", "x", 2), ("e26", "x", 26), ("e900", "x", 900)], block=block).toPandas().sort_values(["ticker", "dt"])
    assert len(got) == len(rows) and list(got.columns) == ["ticker", "dt", "x", "e2", "e26", "e900"]
    for k, g in got.groupby("ticker"):
        for span in (2, 26, 900):
            a, acc, want = 2 / (span + 1), np.nan, []
            for x in g["x"]:
                if x == x:
                    acc = x if acc != acc else acc * (1 - a) + x * a
                want.append(acc)
            assert np.allclose(g[f"e{span}"].astype(float), want, rtol=1e-12, atol=1e-12, equal_nan=True), (k, span)


@pytest.mark.parametrize("block", [3, 256])
def test_blocked_correlations(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 14)) + rng.normal(size=(90, 1)) * np.linspace(-1, 1, 14)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 1.0  # constant: no correlation
    rows = [(f"t{j:02d}", i, float(x[i, j])) for i in range(90) for j in range(14) if x[i, j] == x[i, j]] + [("few", 1, 0.5), ("t00", 500, None)]
    df = spark.createDataFrame(rows, "ticker string, dt int, daily_return double").repartition(4)
    want = {}
    wide = pd.DataFrame(x)
    for i in range(14):
        for j in range(i + 1, 14):
            both = wide[[i, j]].dropna()
            c = both[i].corr(both[j])
            if c == c and 3 not in (i, j):
                want[f"t{i:02d}", f"t{j:02d}"] = (len(both), c)
    got = {(r.src, r.dst): (r.n, r.corr) for r in G.correlation_pairs(df, min_obs=20, block=block).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
    some = {(r.src, r.dst) for r in G.correlation_pairs(df, min_obs=20, block=block, pos=0.3, neg=-0.2).collect()}
    assert some == {k for k, (_, c) in want.items() if c >= 0.3 or c <= -0.2} and 0 < len(some) < len(want)
    assert G.correlation_pairs(df.limit(0)).count() == 0
