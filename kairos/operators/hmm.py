"""Gaussian hidden Markov models of many series at once.

Each series (key) has a model of its own. Its rows are cut into time blocks;
a block's effect on the state is one k x k transfer matrix, and matrices of
neighbouring blocks multiply, so the blocks of a series are worked on by many
tasks: (1) a matrix for each block, (2) their prefix and suffix products by
key, which hold one small matrix for ``block`` rows, (3) forward-backward or
Viterbi inside each block from the vectors at its ends. Baum-Welch adds the
blocks' expected counts by key; Viterbi is the same scan with (max, +).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import layer_table, ship_package

FLOOR = 1e-6  # added to variances, in units of the series' own variance
FEW_KEYS = 100_000  # models are broadcast up to so many counted series


def blocks_of(df: DataFrame, key: str, t: str, cols, k: int, block: int, init: str) -> DataFrame:
    """(key, block, ts, xs, gs): standardised features of up to ``block``
    consecutive rows, flat, and each row's group for the first guess (``k``
    equal groups by ``init``). Rows with a null or NaN feature are left out.
    Windows go over one series in time: one row for each date."""
    ok = df
    for c in cols:
        ok = ok.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    x = ok.select(F.col(key).alias("key"), F.col(t).alias("t"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                  F.col(init).cast("double").alias("init"))
    n = len(cols)
    stats = x.groupBy("key").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(n)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(n)])
    w = Window.partitionBy("key")
    x = x.join(stats, "key").withColumn("pos", F.row_number().over(w.orderBy("t")) - 1).withColumn("g", F.ntile(k).over(w.orderBy("init", "t")) - 1)
    z = F.array(*[F.when(F.col(f"s{i}") > 0, (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(0.0) for i in range(n)])
    rows = x.groupBy("key", F.floor(F.col("pos") / block).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t", z.alias("z"), "g"))).alias("r"))  # at most ``block`` rows
    return rows.select("key", "block", F.col("r.t").alias("ts"), F.flatten("r.z").alias("xs"), F.col("r.g").alias("gs"))


# -- numpy over many blocks at once: arrays are (blocks, time, ...) ----------------

@dataclass
class Theta:
    """Models, one for each row: start, step, mean, cov."""

    pi: np.ndarray
    a: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(rows, k: int, d: int) -> "Theta":
        v = np.asarray(rows, float).reshape(-1, k + k * k + k * d + k * d * d)
        c = np.cumsum([k, k * k, k * d])
        return Theta(v[:, :c[0]], v[:, c[0]:c[1]].reshape(-1, k, k), v[:, c[1]:c[2]].reshape(-1, k, d), v[:, c[2]:].reshape(-1, k, d, d))

    def flat(self) -> list:
        n = len(self.pi)
        return np.hstack([x.reshape(n, -1) for x in (self.pi, self.a, self.mean, self.cov)]).tolist()


def _padded(rows, d: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) // d for r in rows])
    x = np.zeros((len(rows), int(n.max(initial=1)), d))
    for i, r in enumerate(rows):
        x[i, :n[i]] = np.asarray(r).reshape(-1, d)
    return x, n


def log_density(x: np.ndarray, th: Theta) -> np.ndarray:
    """(blocks, time, k) log densities."""
    inv, (_, det) = np.linalg.inv(th.cov), np.linalg.slogdet(th.cov)
    diff = x[:, :, None] - th.mean[:, None]
    q = np.einsum("btki,bkij,btkj->btk", diff, inv, diff, optimize=True)
    return -0.5 * (q + det[:, None] + x.shape[-1] * np.log(2 * np.pi))


def _scaled(lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = lb.max(axis=2)
    return np.exp(lb - top[:, :, None]), top


def transfer(b: np.ndarray, n: np.ndarray, first: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Product of the steps of each block, scaled to a largest entry of one.
    The first step of a series has no transition before it."""
    k = b.shape[2]
    p = np.where(first[:, None, None], np.eye(k), a) * b[:, 0, None, :]
    for t in range(1, b.shape[1]):
        nxt = np.einsum("bij,bjk->bik", p, a) * b[:, t, None, :]
        p = np.where((t < n)[:, None, None], nxt, p)
        p /= p.max(axis=(1, 2), keepdims=True)
    return p


def max_transfer(lb, n, first, la):
    """``transfer`` in the (max, +) semiring."""
    k = lb.shape[2]
    with np.errstate(divide="ignore"):
        eye = np.log(np.eye(k))
    p = np.where(first[:, None, None], eye, la) + lb[:, 0, None, :]
    for t in range(1, lb.shape[1]):
        nxt = (p[:, :, :, None] + la[:, None]).max(axis=2) + lb[:, t, None, :]
        p = np.where((t < n)[:, None, None], nxt, p)
    return p


def expected(x, n, first, th: Theta, enter, leave):
    """Expected counts of each block from the normalised forward vector at its
    entry and the backward vector at its end: flat rows of (log likelihood,
    start, transitions, sum of weights, of x, of x x')."""
    b, top = _scaled(log_density(x, th))
    size, length, k = b.shape
    live = np.arange(length) < n[:, None]
    alpha, before = np.zeros_like(b), np.zeros_like(b)
    cur, ll = enter, np.zeros(size)
    for t in range(length):
        prior = np.einsum("bi,bij->bj", cur, th.a)
        if t == 0:
            prior = np.where(first[:, None], cur, prior)
        before[:, t] = cur
        nxt = prior * b[:, t]
        c = nxt.sum(axis=1, keepdims=True)
        on = live[:, t]
        cur = np.where(on[:, None], nxt / c, cur)
        ll += np.where(on, np.log(c[:, 0]) + top[:, t], 0.0)
        alpha[:, t] = cur
    gamma, trans, back = np.zeros_like(b), np.zeros((size, k, k)), leave
    for t in range(length - 1, -1, -1):
        on = live[:, t]
        g = alpha[:, t] * back
        gamma[:, t] = np.where(on[:, None], g / g.sum(axis=1, keepdims=True), 0.0)
        into = b[:, t] * back
        xi = before[:, t, :, None] * th.a * into[:, None, :]
        moves = on & ~(first & (t == 0))
        trans += np.where(moves[:, None, None], xi / xi.sum(axis=(1, 2), keepdims=True), 0.0)
        prev = np.einsum("bij,bj->bi", th.a, into)
        back = np.where(on[:, None], prev / prev.sum(axis=1, keepdims=True), back)
    start = np.where(first[:, None], gamma[:, 0], 0.0)
    s1 = np.einsum("btk,bti->bki", gamma, x)
    s2 = np.einsum("btk,bti,btj->bkij", gamma, x, x, optimize=True)
    return np.hstack([ll[:, None], start, *(y.reshape(size, -1) for y in (trans, gamma.sum(axis=1), s1, s2))])


def maximise(total: np.ndarray, k: int, d: int) -> tuple[Theta, float]:
    """The models that the summed counts of one series give."""
    c = np.cumsum([1, k, k * k, k, k * d])
    start, trans = total[c[0]:c[1]], total[c[1]:c[2]].reshape(k, k)
    s0, s1, s2 = total[c[2]:c[3]], total[c[3]:c[4]].reshape(k, d), total[c[4]:].reshape(k, d, d)
    rows = trans.sum(axis=1, keepdims=True)
    a = np.where(rows > 0, trans / np.where(rows > 0, rows, 1), 1 / k)
    w = np.maximum(s0, 1e-12)
    mean = s1 / w[:, None]
    cov = s2 / w[:, None, None] - mean[:, :, None] * mean[:, None, :]
    cov = (cov + cov.transpose(0, 2, 1)) / 2 + FLOOR * np.eye(d)
    bad = np.linalg.eigvalsh(cov).min(axis=1) < FLOOR / 2  # a state that hardly occurs
    cov[bad] = np.eye(d)
    return Theta(start[None] / start.sum(), a[None], mean[None], cov[None]), float(total[0])


def decode(lb, n, first, la, enter, end):
    """Best path through each block from the state before it (of a first
    block: its first state) to its last state."""
    size, length, k = lb.shape
    r = np.arange(size)
    cur = np.where(first[:, None], np.where(np.arange(k) == enter[:, None], 0.0, -np.inf), la[r, enter]) + lb[:, 0]
    back = np.zeros((size, length, k), np.int64)
    for t in range(1, length):
        step = cur[:, :, None] + la
        back[:, t] = step.argmax(axis=1)
        cur = np.where((t < n)[:, None], step.max(axis=1) + lb[:, t], cur)
    path = np.zeros((size, length), np.int64)
    state = end.copy()
    for t in range(length - 1, -1, -1):
        path[:, t] = state
        state = np.where(t < n, back[r, t, state], state)
    return path


def _batch(pdf, k: int, d: int):
    x, n = _padded(pdf["xs"], d)
    return x, n, (pdf["block"] == 0).to_numpy(), Theta.of(np.stack(pdf["theta"].to_list()), k, d)


# -- Spark ---------------------------------------------------------------------

class _Model:
    """The blocks of all series, and passes over them."""

    def __init__(self, blocks: DataFrame, k: int, d: int):
        self.blocks, self.k, self.d = blocks, k, d
        kind = blocks.schema["key"].dataType.simpleString()
        self.head = f"key {kind}, block int"
        self.key = f"key {kind}"
        self.keys = blocks.select("key").distinct().count()

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.keys <= FEW_KEYS else df

    def first_guess(self) -> DataFrame:
        k, d = self.k, self.d

        def sums(it):
            for pdf in it:
                x, n = _padded(pdf["xs"], d)
                g, _ = _padded(pdf["gs"], 1)
                live = np.arange(x.shape[1]) < n[:, None]
                one = (g[:, :, 0][:, :, None] == np.arange(k)) & live[:, :, None]
                s1 = np.einsum("btk,bti->bki", one, x).reshape(len(x), -1)
                s2 = np.einsum("bti,btj->bij", x, x).reshape(len(x), -1)
                yield pd.DataFrame({"key": pdf["key"], "v": list(np.hstack([n[:, None], one.sum(axis=1), s1, s2]))})

        def guess(pdf):
            v = np.sum(np.stack(pdf["v"].to_list()), axis=0)
            n, s0, s1, s2 = v[0], v[1:1 + k], v[1 + k:1 + k + k * d].reshape(k, d), v[1 + k + k * d:].reshape(d, d)
            th = Theta(np.full((1, k), 1 / k), np.full((1, k, k), 1 / k), (s1 / np.maximum(s0, 1)[:, None])[None],
                       np.broadcast_to(s2 / n + FLOOR * np.eye(d), (1, k, d, d)))
            return pd.DataFrame({"key": [pdf["key"].iloc[0]], "theta": th.flat(), "ll": [-np.inf], "gain": [np.inf]})

        parts = self.blocks.select("key", "xs", "gs").mapInPandas(sums, f"{self.key}, v array<double>")
        return parts.groupBy("key").applyInPandas(guess, f"{self.key}, theta array<double>, ll double, gain double")

    def em_step(self, models: DataFrame) -> DataFrame:
        """One Baum-Welch step of the series in ``models``."""
        k, d = self.k, self.d
        rows = self.blocks.join(self.small(models), "key").select("key", "block", "xs", "theta", "ll")

        def matrices(it):
            for pdf in it:
                x, n, first, th = _batch(pdf, k, d)
                p = transfer(_scaled(log_density(x, th))[0], n, first, th.a)
                yield pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "pi": th.pi.tolist(), "m": p.reshape(len(p), -1).tolist()})

        def ends(pdf):
            pdf = pdf.sort_values("block")
            m = np.stack(pdf["m"].to_list()).reshape(-1, k, k)
            enter, leave = np.empty((len(m), k)), np.empty((len(m), k))
            v = np.asarray(pdf["pi"].iloc[0])
            for i in range(len(m)):
                enter[i] = v
                v = v @ m[i]
                v = v / v.sum()
            v = np.full(k, 1 / k)
            for i in range(len(m) - 1, -1, -1):
                leave[i] = v
                v = m[i] @ v
                v = v / v.sum()
            return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "enter": enter.tolist(), "leave": leave.tolist()})

        def counts(it):
            for pdf in it:
                x, n, first, th = _batch(pdf, k, d)
                v = expected(x, n, first, th, np.stack(pdf["enter"].to_list()), np.stack(pdf["leave"].to_list()))
                # Blocks of one series in one batch are added before the shuffle.
                for key, at in pdf.groupby("key").indices.items():
                    yield pd.DataFrame({"key": [key], "old": [pdf["ll"].iloc[at[0]]], "v": [v[at].sum(axis=0)]})

        def update(pdf):
            th, ll = maximise(np.sum(np.stack(pdf["v"].to_list()), axis=0), k, d)
            return pd.DataFrame({"key": [pdf["key"].iloc[0]], "theta": th.flat(), "ll": [ll], "gain": [ll - pdf["old"].iloc[0]]})

        m = rows.mapInPandas(matrices, f"{self.head}, pi array<double>, m array<double>")
        e = m.groupBy("key").applyInPandas(ends, f"{self.head}, enter array<double>, leave array<double>")
        s = rows.join(e, ["key", "block"]).mapInPandas(counts, f"{self.key}, old double, v array<double>")
        return s.groupBy("key").applyInPandas(update, f"{self.key}, theta array<double>, ll double, gain double")

    def paths(self, models: DataFrame) -> DataFrame:
        """(key, t, state) of every row: the Viterbi paths."""
        k, d = self.k, self.d
        rows = self.blocks.join(self.small(models), "key").select("key", "block", "ts", "xs", "theta")

        def logs(x, th):
            with np.errstate(divide="ignore"):
                return log_density(x, th), np.log(th.a)

        def matrices(it):
            for pdf in it:
                x, n, first, th = _batch(pdf, k, d)
                lb, la = logs(x, th)
                with np.errstate(divide="ignore"):
                    yield pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "pi": np.log(th.pi).tolist(),
                                        "m": max_transfer(lb, n, first, la).reshape(len(lb), -1).tolist()})

        def ends(pdf):
            pdf = pdf.sort_values("block")
            m = np.stack(pdf["m"].to_list()).reshape(-1, k, k)
            v = [np.asarray(pdf["pi"].iloc[0])]
            for x in m:
                v.append((v[-1][:, None] + x).max(axis=0))
            state = int(v[-1].argmax())
            enter, end = [0] * len(m), [0] * len(m)
            for i in range(len(m) - 1, -1, -1):
                end[i] = state
                state = enter[i] = int((v[i] + m[i][:, state]).argmax())
            return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "enter": enter, "finish": end})

        def inside(it):
            for pdf in it:
                x, n, first, th = _batch(pdf, k, d)
                lb, la = logs(x, th)
                path = decode(lb, n, first, la, pdf["enter"].to_numpy(), pdf["finish"].to_numpy())
                yield pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "states": [p[:j].tolist() for p, j in zip(path, n)]})

        m = rows.mapInPandas(matrices, f"{self.head}, pi array<double>, m array<double>")
        e = m.groupBy("key").applyInPandas(ends, f"{self.head}, enter int, finish int")
        s = rows.select("key", "block", "xs", "theta").join(e, ["key", "block"]).mapInPandas(inside, f"{self.head}, states array<int>")
        out = self.blocks.select("key", "block", "ts").join(s, ["key", "block"]).select("key", F.explode(F.arrays_zip("ts", "states")).alias("r"))
        return out.select("key", F.col("r.ts").alias("t"), F.col("r.states").alias("state"))


def fit_paths(df: DataFrame, key="ticker", t="dt", cols=("daily_return", "realized_vol_20d", "return_5d"), k=3, rounds=200, tol=1e-2,
              block=256, init: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Models (key, theta, ll, gain) and Viterbi paths (key, t, state) of all
    series of ``df``, full covariances, features standardised by series.

    The first guess takes ``k`` equal groups by ``init`` (default: the last
    feature). A series stops when a step gains less than ``tol`` in log
    likelihood, or after ``rounds`` steps; its blocks are not read again.
    Only the number of open series reaches the driver. A series with fewer
    rows than states plus features is left out; an empty table gives empty
    results.
    """
    ship_package(df.sparkSession)
    # Tables rather than checkpoints: a checkpoint keeps the size estimate of
    # its plan, which grows without bound when each step joins the last one.
    blocks = layer_table(blocks_of(df, key, t, cols, k, block, init or cols[-1]), "hmm-blocks")
    sizes = blocks.groupBy("key").agg(F.sum(F.size("ts")).alias("n")).filter(F.col("n") >= k + len(cols)).select("key")
    model = _Model(blocks.join(sizes, "key", "left_semi"), k, len(cols))
    models = layer_table(model.first_guess(), "hmm-models")
    done = models.limit(0)
    for _ in range(rounds):
        models = layer_table(model.em_step(models), "hmm-models")
        done = done.unionByName(models.filter(F.col("gain") < tol))
        models = models.filter(F.col("gain") >= tol)
        if models.isEmpty():
            break
    models = layer_table(done.unionByName(models), "hmm-models")
    return models, model.paths(models)
