"""Quality scores: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bpe import _ranges, distinct
from .common import prepare, stage, utf8, words

FOURIER = 256  # random features
RIDGE = 1e-3  # for each learning row
BINS = 1000  # score bins of the calibration
SEED = 7

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32, 9, 11, 12, 13], "feed": [10],
            "stop": [46], "comma": [44], "loud": [33, 63], "bar": [124], "odd": [*range(35, 39), 42, 43, 61, 64, *range(91, 97), 126, 60, 62],
            "mark": [34, 39, 40, 41, 45, 47, 58, 59], "beyond": range(128, 256)}
STATS = [*_CLASSES, "entropy", "top_byte", "log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words",
         "capital_words", "distinct_lines", "mean_line", "distinct_pairs"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """n x len(STATS) statistics of whole texts; all 0 for empty ones."""
    n, size = len(off) - 1, np.diff(off)
    hist = np.zeros((n, 256))
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        doc = np.repeat(np.arange(hi - lo), size[lo:hi])
        hist[lo:hi] = np.bincount(doc * 256 + data[off[lo]:off[hi]], minlength=(hi - lo) * 256).reshape(-1, 256)
    share = hist / np.maximum(size, 1)[:, None]
    cols = [share[:, list(b)].sum(axis=1) for b in _CLASSES.values()]
    cols.append(-(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1))
    cols.append(share.max(axis=1, initial=0))
    s, e, first = words(data, off)
    lens, n_words = e - s, np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    some = np.maximum(n_words, 1)
    per = lambda x: np.bincount(doc, weights=x, minlength=n)
    cols += [np.log1p(size), np.log1p(n_words), per(lens) / some, per(lens > 12) / some, per(lens < 3) / some]
    _, word = distinct(data[_ranges(s, lens)], np.concatenate(([0], np.cumsum(lens))))
    kinds = word.max(initial=0) + 1
    different = lambda d, x: np.bincount(np.unique(d * (x.max(initial=0) + 1) + x) // (x.max(initial=0) + 1), minlength=n)
    cols.append(different(doc, word) / some)
    capital = (data[s] >= 65) & (data[s] <= 90) if len(s) else np.zeros(0)
    cols.append(per(capital) / some)
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    cut[np.flatnonzero(data == 10) + 1] = True
    lines = np.flatnonzero(cut)
    _, line = distinct(data, lines)
    line_doc = np.searchsorted(off, lines[:-1], side="right") - 1
    n_lines = np.bincount(line_doc, minlength=n)[:n]
    cols.append(different(line_doc, line)[:n] / np.maximum(n_lines, 1))
    cols.append(np.log1p(size / np.maximum(n_lines, 1)))
    same = doc[1:] == doc[:-1]
    pair = (word[:-1] * kinds + word[1:])[same]
    _, pair = np.unique(pair, return_inverse=True)
    cols.append(different(doc[1:][same], pair) / np.maximum(n_words - 1, 1))
    out = np.stack(cols, axis=1)
    out[size == 0] = 0
    return out


class Model:
    """Scaling, random features, ridge weights and the calibration curve."""

    def __init__(self, mean, std):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, std
        d = len(mean)
        # Gaussian kernel of width sqrt(d) on standardised statistics.
        self.w = rng.normal(0, 1 / np.sqrt(d), (d, FOURIER))
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)
        self.beta = np.zeros(FOURIER + 1)
        self.curve = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x):
        return self.features(x) @ self.beta

    def score(self, x):
        r = self.raw(x)
        at, p = self.curve
        # The curve has flat parts; a thousandth of the raw score keeps the order within them.
        return np.clip(0.999 * np.interp(r, at, p) + 0.001 * np.clip(r, 0, 1), 0, 1)


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, m in zip(weight.tolist(), mean.tolist()):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, k2 = blocks.pop()
            w1, m1, k1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.repeat([m for _, m, _ in blocks], [k for *_, k in blocks])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(-1, len(STATS))


def _stats(text):
    @arrow_udf("binary")
    def run(t: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(t), 1024):
            out += [r.tobytes() for r in statistics(*utf8(t.slice(lo, 1024))).astype("<f8")]
        return pa.array(out, pa.binary())

    return run(text)


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """Sum over all partitions of the matrix that ``make`` sums for a batch:
    each partition gives its rows, equal row numbers are added on the
    executors, and one finished matrix reaches the driver."""
    def part(batches):
        total = None
        for b in batches:
            m = make(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(r, np.float64) for r in table.column("row").to_pylist()], axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(part, "i long, row binary")
    got = parts.groupBy("i").applyInArrow(add, "i long, row binary").collect()
    out = np.zeros((len(got), width))
    for r in got:
        out[r["i"]] = np.frombuffer(r["row"], np.float64)
    return out


def fit(rows: DataFrame) -> Model:
    """A model from (stats, label, fold): fold 1 calibrates, the others learn."""
    d = len(STATS)
    learn, tune = rows.filter("fold <> 1"), rows.filter("fold = 1")
    m = _sums(learn, lambda x, y: np.vstack([np.ones(d) * len(x), x.sum(axis=0), (x * x).sum(axis=0)]), d)
    if not len(m):
        return Model(np.zeros(d), np.ones(d))
    mean = m[1] / m[0]
    model = Model(mean, np.sqrt(np.maximum(m[2] / m[0] - mean ** 2, 0)) + 1e-6)

    def normal(x, y):
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    a = _sums(learn, normal, FOURIER + 2)
    ridge = RIDGE * m[0][0] * np.diag([*[1.0] * FOURIER, 0.0]) / FOURIER + 1e-9 * np.eye(FOURIER + 1)
    model.beta = np.linalg.solve(a[:, :-1] + ridge, a[:, -1])

    def bins(x, y):
        at = np.clip((model.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(float)

    h = _sums(tune, bins, BINS)
    if not len(h):
        h = _sums(learn, bins, BINS)
    used = np.flatnonzero(h[0])
    model.curve = ((used + 0.5) / BINS * 2 - 0.5, isotonic(h[0][used], h[1][used] / h[0][used]))
    return model


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Statistics of whole texts are staged once. Labels of rows whose
    crc32(doc_id as text) mod ``folds`` is ``held`` are never read; a score
    depends on the text alone. Null texts count as empty and are scored, too;
    null ids and null labels are not learned from; no labels: 0.5 for all;
    repeated rows stay rows; an empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    stats = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), _stats(F.col(text_col).cast("string")).alias("stats")), "stats")
    fold = lambda c: F.crc32(c.cast("long").cast("string").cast("binary")) % folds
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("double").alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("label_id").isNotNull()).withColumn("fold", fold(F.col("label_id"))).filter(F.col("fold") != held)
    rows = stage(stats.join(known, F.col("doc_id") == F.col("label_id")).select("stats", "label", "fold"), "labelled")
    shared = spark.sparkContext.broadcast(fit(rows))  # some 60 KB

    @arrow_udf("double")
    def score(s: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_matrix(s)), pa.float64())

    return stats.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held, F.lit(False)).alias("held_out"), score("stats").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
