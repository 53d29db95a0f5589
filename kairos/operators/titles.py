"""Batched text scorer (N1, U4): score in [-1, 1] and label in one pass.

``score_text`` runs any scorer over Arrow batches: its ``load`` is called once
in a worker process and gives a function from a list of texts to scores; the
label comes from the same pass. The scorer of this module is a ridge regression
on hashed word counts (``BUCKETS`` wide, rows of length one), fitted on labelled
rows of +1 and -1. The fit is one pass: tasks add their parts of the normal
equations, which meet in two levels by blocks of rows; only the sums, a matrix
of fixed size, reach the driver.

A null text, or one without a word, scores 0 and is neutral. Rows without a
label of +1 or -1 or without a word teach nothing; no learning row gives zero
weights.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship_package

BUCKETS = 1024
BLOCK = 41  # rows of the normal equations that travel together: 25 blocks
SPREAD = 64  # partial sums of a block after the first level
CHUNK = 256  # texts scored at once
KNOWN = 1 << 17  # words whose bucket a worker remembers
WORD = re.compile(r"\w+")

_BUCKET: dict[str, int] = {}


def bucket(word: str) -> int:
    b = _BUCKET.get(word)
    if b is None:
        if len(_BUCKET) >= KNOWN:
            _BUCKET.clear()
        b = _BUCKET[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return b


def features(texts: list) -> np.ndarray:
    """One row a text: counts of its lower-case words by bucket, scaled to
    length one, and a constant; all zero for a text without words."""
    x = np.zeros((len(texts), BUCKETS + 1))
    for i, text in enumerate(texts):
        seen = [bucket(m.group()) for m in WORD.finditer(text.lower())] if text else []
        if seen:
            counts = np.bincount(seen, minlength=BUCKETS)
            x[i, :BUCKETS] = counts / np.sqrt(float(np.dot(counts, counts)))
            x[i, BUCKETS] = 1.0
    return x


@dataclass(frozen=True)
class TitleModel:
    """Weights of the buckets and of the constant; also the ``load`` of a scorer."""

    weights: np.ndarray

    def __call__(self) -> Callable[[list], np.ndarray]:
        return self.score

    def score(self, texts: list) -> np.ndarray:
        return np.clip(features(texts) @ self.weights, -1.0, 1.0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's part of the normal equations, a row for each block. Column
    BUCKETS + 1 is the right side."""
    total = np.zeros((BUCKETS + 1, BUCKETS + 2))
    rows = 0
    for batch in batches:
        texts, marks = batch.column("text"), batch.column("mark").to_numpy(zero_copy_only=False)
        for a in range(0, batch.num_rows, CHUNK):
            x = features(texts.slice(a, CHUNK).to_pylist())
            total[:, :-1] += x.T @ x
            total[:, -1] += x.T @ marks[a:a + CHUNK]
            rows += len(x)
    if rows:
        part = TaskContext.get().partitionId() % SPREAD
        starts = range(0, len(total), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in starts], pa.int32()), pa.array([part] * len(starts), pa.int32()),
                                          pa.array([total[a:a + BLOCK].tobytes() for a in starts], pa.binary())], ["block", "part", "sums"])


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = None, 0
    for batch in batches:
        for raw, p in zip(batch.column("sums"), batch.column("part").to_pylist()):
            one = np.frombuffer(raw.as_buffer(), dtype=np.float64)
            total, part = (one.copy() if total is None else total + one), p
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                     ["block", "part", "sums"])


def fit_titles(df: DataFrame, text: str, mark: str, ridge: float = 1.0) -> TitleModel:
    """The model of the rows whose ``mark`` is 1 or -1 (others teach nothing)."""
    ship_package(df.sparkSession)
    schema = "block int, part int, sums binary"
    rows = df.select(F.col(text).alias("text"), F.col(mark).cast("double").alias("mark")).filter("text IS NOT NULL AND mark IN (1, -1)")
    first = rows.mapInArrow(_sums, schema).groupBy("block", "part").applyInArrow(_add, schema)
    blocks = first.groupBy("block").applyInArrow(_add, schema).orderBy("block").collect()  # 25 rows, a matrix of fixed size
    if not blocks:
        return TitleModel(np.zeros(BUCKETS + 1))
    total = np.concatenate([np.frombuffer(bytes(b["sums"]), dtype=np.float64) for b in blocks]).reshape(BUCKETS + 1, BUCKETS + 2)
    return TitleModel(np.linalg.solve(total[:, :-1] + ridge * np.eye(BUCKETS + 1), total[:, -1]))


_LOADED: dict = {}


def _loaded(key: str, shared) -> Callable[[list], np.ndarray]:
    # A function of the module, so that tasks share the worker's own table.
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = pickle.loads(shared.value)()
    return _LOADED[key]


def _scorer(shared, key: str, band: float):
    @arrow_udf("struct<score:double,label:string>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _loaded(key, shared)
        for texts in batches:
            parts = [np.asarray(run([t or "" for t in texts.slice(a, CHUNK).to_pylist()]), dtype=float) for a in range(0, len(texts), CHUNK)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            label = np.where(s > band, "positive", np.where(s < -band, "negative", "neutral"))
            yield pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(label.tolist(), pa.string())], ["score", "label"])

    return score


def score_text(df: DataFrame, text: str, load: Callable[[], Callable[[list], np.ndarray]], band: float = 0.1) -> Column:
    """struct(score, label) of ``text``. ``load`` travels to the workers
    once and is called once in each; the function it gives gets at most
    ``CHUNK`` texts (null: empty) and returns scores in [-1, 1]. Above ``band``
    is positive, below its negative is negative."""
    spark = df.sparkSession
    ship_package(spark)
    return _scorer(spark.sparkContext.broadcast(cloudpickle.dumps(load)), uuid.uuid4().hex, band)(F.col(text))


def with_scores(df: DataFrame, text: str, load, band: float = 0.1) -> DataFrame:
    """Adds sentiment_score, sentiment_label and sentiment_confidence (the
    score's size), the columns of the daily sentiment (D4)."""
    held = "__scored"
    while held in df.columns:
        held += "_"
    return df.withColumn(held, score_text(df, text, load, band)).withColumns({
        "sentiment_score": F.col(f"{held}.score"), "sentiment_label": F.col(f"{held}.label"), "sentiment_confidence": F.abs(f"{held}.score")}).drop(held)
