"""Hidden Markov regimes against a plain forward-backward and Viterbi."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kairos.operators import hmm as H


def density(x, mean, cov):
    d = x - mean
    return np.exp(-0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1)) / np.sqrt(np.linalg.det(2 * np.pi * cov))


def plain(x, init, k, rounds, tol):
    """One series, one step of time after the other."""
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    n, d = x.shape
    order = np.argsort(init, kind="stable")
    group = np.empty(n, int)
    sizes = [n // k + (i < n % k) for i in range(k)]
    group[order] = np.repeat(np.arange(k), sizes)
    pi, a = np.full(k, 1 / k), np.full((k, k), 1 / k)
    mean = np.array([x[group == g].mean(axis=0) for g in range(k)])
    cov = np.array([x.T @ x / n + H.FLOOR * np.eye(d)] * k)
    old = -np.inf
    for _ in range(rounds):
        b = np.array([density(x, m, c) for m, c in zip(mean, cov)]).T
        alpha, c = np.zeros((n, k)), np.zeros(n)
        for t in range(n):
            v = (pi if t == 0 else alpha[t - 1] @ a) * b[t]
            c[t] = v.sum()
            alpha[t] = v / c[t]
        beta = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            beta[t] = a @ (b[t + 1] * beta[t + 1]) / c[t + 1]
        gamma = alpha * beta
        xi = sum(alpha[t - 1][:, None] * a * (b[t] * beta[t]) / c[t] for t in range(1, n))
        pi, a = gamma[0] / gamma[0].sum(), xi / xi.sum(axis=1, keepdims=True)
        w = gamma.sum(axis=0)
        mean = gamma.T @ x / w[:, None]
        cov = np.array([(gamma[:, j, None] * x).T @ x / w[j] - np.outer(mean[j], mean[j]) + H.FLOOR * np.eye(d) for j in range(k)])
        ll = np.log(c).sum()
        if ll - old < tol:
            break
        old = ll
    lb = np.log(np.array([density(x, m, c) for m, c in zip(mean, cov)]).T)
    with np.errstate(divide="ignore"):
        la, cur = np.log(a), np.log(pi) + lb[0]
    back = []
    for t in range(1, n):
        step = cur[:, None] + la
        back.append(step.argmax(axis=0))
        cur = step.max(axis=0) + lb[t]
    path = [int(cur.argmax())]
    for p in back[::-1]:
        path.append(int(p[path[-1]]))
    return np.concatenate([pi, a.ravel(), mean.ravel(), cov.ravel()]), ll, path[::-1]


def check(df, rounds, tol, block, cols=("daily_return", "realized_vol_20d", "return_5d")):
    models, paths = H.fit_paths(df, rounds=rounds, tol=tol, block=block, cols=cols)
    theta = {r.key: r for r in models.collect()}
    got = {}
    for r in paths.orderBy("key", "t").collect():
        got.setdefault(r.key, []).append(r.state)
    rows = df.dropna(subset=list(cols)).orderBy("ticker", "dt").toPandas()
    assert set(theta) == set(rows["ticker"])
    for key, g in rows.groupby("ticker"):
        x = g[list(cols)].to_numpy(float)
        th, ll, path = plain(x, x[:, -1], 3, rounds, tol)
        assert np.allclose(theta[key].theta, th, rtol=1e-9, atol=1e-9), key
        assert abs(theta[key].ll - ll) < 1e-9 * abs(ll) and got[key] == path


def test_every_series(spark):
    """All instruments of the bars, blocks much shorter than the series."""
    from kairos.operators import ml as N
    from kairos.operators import windows as E
    from kairos.plans import fixtures as FX
    b = E.with_realised_vol(E.with_returns(FX.bars_table(spark, SF_SMALL)), ns=(20,))
    feats = N.regime_features(b).select("ticker", "dt", "daily_return", "realized_vol_20d", "return_5d").cache()
    assert feats.count() > 500
    check(feats, rounds=4, tol=1e-2, block=16)


def test_regimes_are_found(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for key, n in (("a", 900), ("b", 301), ("c", 64)):
        state, s = [], 0
        for _ in range(n):
            s = s if rng.random() < 0.97 else int(rng.integers(3))
            state.append(s)
        x = rng.normal(np.array([-2.0, 0.0, 2.0])[state], np.array([1.0, 0.3, 0.5])[state])
        rows += [(key, i, float(v), float(w)) for i, (v, w) in enumerate(zip(x, rng.normal(size=n)))]
        truth[key] = state
    rows += [("short", 0, 1.0, 2.0), ("a", 5000, None, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, dt int, w double, v double").repartition(5)
    models, paths = H.fit_paths(df, cols=("v", "w"), rounds=40, block=50)
    assert {r.key for r in models.collect()} == {"a", "b", "c"}
    got = paths.filter("key = 'a'").orderBy("t").select("state").toPandas()["state"].to_numpy()
    assert len(got) == 900 and np.mean(got == np.array(truth["a"])) > 0.95
    empty, none = H.fit_paths(df.limit(0), cols=("v", "w"))
    assert empty.count() == none.count() == 0


def test_labels_follow_mean_return(spark):
    from kairos.operators import ml as N
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-1, 0.2, 100), rng.normal(1, 0.2, 100), rng.normal(0, 0.2, 100)])
    df = spark.createDataFrame([("s", i, float(v), 0.1 + float(abs(v)), float(v)) for i, v in enumerate(x)],
                               "ticker string, dt int, daily_return double, realized_vol_20d double, return_5d double")
    lab = {r.dt: r.regime_label for r in N.detect_regimes(df, rounds=30).collect()}
    assert (lab[50], lab[150], lab[250]) == ("Bear", "Bull", "Neutral") and len(lab) == 300
    means = {r.regime_label: r.m for r in N.detect_regimes(df, rounds=30).groupBy("regime_label").agg(F.avg("daily_return").alias("m")).collect()}
    assert means["Bear"] < means["Neutral"] < means["Bull"]
