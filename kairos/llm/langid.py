"""Language identification with a blended-spectrum string kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import drop_stage, give_back, prepare, stage, utf8

SIZES = (1, 2, 3)  # bytes of the n-grams
SAMPLE = 4000  # learning rows in all, dealt evenly to the languages
LANGUAGES = 500  # languages that are learned
LANDMARKS = 160  # in all, likewise
MARK_GRAMS = 1 << 14  # sample rows with more distinct n-grams are landmarks only if their language has no other
RIDGE = 1e-2
BLOCK = 1 << 20  # bytes of texts whose n-grams are sorted together


def slices(text: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Parts of at most 256 rows and about ``BLOCK`` bytes (one row at least)."""
    _, off = utf8(text)
    lo = 0
    while lo < len(text):
        hi = min(lo + 256, max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, side="right")) - 1))
        part = text.slice(lo, hi - lo)
        yield part, *utf8(part)
        lo = hi


def spectra(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each n the distinct n-grams (A-Z lower-cased) of at most 256 texts,
    ascending: text number << 24 | bytes. Long data are taken in blocks."""
    out = []
    for size in SIZES:
        found = [np.zeros(0, np.uint32)]
        for lo in range(0, len(data) - size + 1, BLOCK):
            raw = data[lo:lo + BLOCK + size - 1]
            low = raw.astype(np.uint32) + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint32)
            m = len(low) - size + 1
            at = np.arange(lo, lo + m)
            doc = np.searchsorted(off, at, side="right") - 1
            gram = low[:m].copy()
            for k in range(1, size):
                gram = gram << np.uint32(8) | low[k:m + k]
            found.append(np.unique((doc.astype(np.uint32) << np.uint32(24) | gram)[at + size <= off[doc + 1]]))
        out.append(found[1] if len(found) == 2 else np.unique(np.concatenate(found)))
    return out


def tagged(spectrum: list[np.ndarray]) -> np.ndarray:
    """One text's n-grams of all sizes in one ascending array: n << 24 | bytes."""
    return np.concatenate([(g & np.uint32(0xFFFFFF)) | np.uint32(size << 24) for size, g in zip(SIZES, spectrum)])


def norms(grams: np.ndarray) -> np.ndarray:
    """For each n-gram of a text the factor that makes the sum over shared
    n-grams the blended kernel: the mean over n of the number of shared
    n-grams over the root of both texts' numbers."""
    size = (grams >> np.uint32(24)).astype(np.int64)
    return 1 / np.sqrt(np.bincount(size, minlength=4)[size] * len(SIZES))


def products(data: np.ndarray, off: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each text and each row of weights (over the n-grams ``table``) the
    sum over the text's own n-grams, scaled by the text's ``norms``."""
    n = len(off) - 1
    out = np.zeros((n, len(rows)))
    if not len(table):
        return out
    for size, keys in zip(SIZES, spectra(data, off)):
        doc = (keys >> np.uint32(24)).astype(np.int64)
        scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1) * len(SIZES))
        gram = keys & np.uint32(0xFFFFFF) | np.uint32(size << 24)
        at = np.minimum(np.searchsorted(table, gram), len(table) - 1)
        hit = table[at] == gram
        doc, at = doc[hit], at[hit]
        for c, row in enumerate(rows):
            out[:, c] += np.bincount(doc, weights=row[at], minlength=n) * scale
    return out


def landmark_rows(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the landmarks (each ``tagged``), and for each landmark
    the weights whose ``products`` are its kernel values."""
    table = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint32)
    rows = np.zeros((len(marks), len(table)), np.float32)
    for row, grams in zip(rows, marks):
        row[np.searchsorted(table, grams)] = norms(grams)
    return table, rows


def fit(langs_of: list[str], kernel: np.ndarray, marks: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights (languages x landmarks) and biases from the sample's
    languages, its kernel values with the landmarks, and theirs with each
    other: Nystroem features, ridge regression of each language against the rest."""
    langs = sorted(set(langs_of))
    y = np.array([langs.index(lang) for lang in langs_of])
    vals, vecs = np.linalg.eigh((marks + marks.T) / 2)
    ok = vals > 1e-6 * max(vals.max(), 1e-12)
    root = vecs[:, ok] / np.sqrt(vals[ok])
    z1 = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    t = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1 / np.bincount(y)[y]  # languages count alike
    a = (z1 * weight[:, None]).T @ z1 + RIDGE * np.diag([*[1.0] * root.shape[1], 0.0]) + 1e-9 * np.eye(z1.shape[1])
    b = np.linalg.solve(a, (z1 * weight[:, None]).T @ t)
    return langs, (root @ b[:-1]).T, b[-1]


def _lettered(texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = np.zeros(256, bool)
    ascii_[[*range(65, 91), *range(97, 123)]] = True
    at = np.concatenate(([0], np.cumsum(ascii_[data])))
    has = at[off[1:]] > at[off[:-1]]
    for i in np.flatnonzero(~has & (np.diff(off) > 1)).tolist():
        has[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return has


def learning_rows(docs: DataFrame, text_col: str, lang_col: str, key) -> DataFrame:
    """(lang, text, r) of at most ``SAMPLE`` rows, alike for each language:
    those with the least hash of key and text, ranked by r, so reruns take the
    same rows. Of more than ``LANGUAGES`` values of lang the most frequent ones
    are learned."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key, F.lit("langid")).alias("h")).filter(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & key.isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    each = max(1, SAMPLE // len(counts))
    # Twice the wanted share by hash first, so that few rows are ordered.
    share = [(r["lang"], min(1 << 20, -(-2 * each * (1 << 20) // r["n"]))) for r in counts]
    shares = docs.sparkSession.createDataFrame(share, "lang string, share long")
    picked = known.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share"))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", F.xxhash64("text"))
    picked = picked.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= each)
    return picked.select("lang", "text", "r")


def model(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, the n-grams of the landmarks, their weights for each language
    and the biases. The driver gets the landmarks' n-grams and one kernel value
    for each sample row and landmark, never a text; as the kernel is a sum over
    n-grams, landmarks and ridge weights fold into one weight for each n-gram
    and language."""
    @arrow_udf("long")
    def number(text: pa.Array) -> pa.Array:
        return pa.array([sum(map(len, spectra(*utf8(text.slice(i, 1))))) for i in range(len(text))], pa.int64())

    @arrow_udf("binary")
    def grams(text: pa.Array) -> pa.Array:
        return pa.array([tagged(spectra(*utf8(text.slice(i, 1)))).tobytes() for i in range(len(text))], pa.binary())

    sample = stage(rows.withColumn("size", number("text")), "langid-sample")
    n = sample.select("lang").distinct().count()
    first = Window.partitionBy("lang").orderBy(F.col("size") > MARK_GRAMS, "r")
    chosen = sample.withColumn("m", F.row_number().over(first)).filter(F.col("m") <= max(1, LANDMARKS // max(1, n)))
    marks = [np.frombuffer(r["g"], np.uint32) for r in chosen.select("lang", "m", grams("text").alias("g")).orderBy("lang", "m").collect()]
    table, weights = landmark_rows(marks)
    shared = sample.sparkSession.sparkContext.broadcast((table, weights))

    @arrow_udf("array<double>")
    def kernel(text: pa.Array) -> pa.Array:
        out = [k for _, data, off in slices(text) for k in products(data, off, *shared.value).tolist()]
        give_back()
        return pa.array(out, pa.list_(pa.float64()))

    got = sample.select("lang", kernel("text").alias("k")).collect()
    shared.destroy()
    drop_stage(sample)
    if not got:
        return [], table, weights, np.zeros(0)
    own = np.array([[float(row[np.searchsorted(table, g)].astype(np.float64) @ norms(g)) for row in weights] for g in marks])
    langs, coef, bias = fit([r["lang"] for r in got], np.array([r["k"] for r in got]), own)
    return langs, table, (coef @ weights).astype(np.float32), bias


def predictor(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key=None, learn=None, unlearned: str = "und"):
    """A column function text -> struct(lang_pred, score), fitted on the rows
    of ``docs`` that ``learn`` keeps. The fit takes a bounded sample
    (``SAMPLE`` rows); no learning rows: lettered texts are ``unlearned``,
    others ``und``, all with score 0."""
    prepare(docs.sparkSession)
    key = F.col("doc_id").cast("string") if key is None else key
    rows = learning_rows(docs.filter(learn) if learn is not None else docs, text_col, lang_col, key)
    fitted = model(rows) if rows is not None else ([], None, None, None)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # landmarks' n-grams x languages

    @arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        langs, table, weights, bias = shared.value
        pred, score = [], []
        for part, data, off in slices(text):
            has = _lettered(part, data, off)
            if not langs:
                pred += [unlearned if h else "und" for h in has.tolist()]
                score += [0.0] * len(part)
                continue
            s = products(data, off, table, weights) + bias
            best = s.argmax(axis=1)
            pred += [langs[c] if h else "und" for c, h in zip(best.tolist(), has.tolist())]
            score += np.where(has, np.clip((s.max(axis=1) + 1) / 2, 0, 1), 0.0).tolist()
        give_back()
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held`` are held out:
    never learned from. Learning reads text and non-null lang only; the
    prediction reads text only. Null texts and texts without a letter are
    ``und`` with score 0. Null ids are neither held out nor learned from;
    repeated rows are rows; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    key = F.col("doc_id").cast("long").cast("string")
    out = F.coalesce(F.crc32(key.cast("binary")) % folds == held, F.lit(False))
    predict = predictor(d, key=key, learn=~out)
    p = d.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), predict("text").alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a language (not ``und``), columns unchanged;
    whatever their names; without learning rows only null and letterless texts go."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    key = F.col("doc_id").cast("long").cast("string")
    predict = predictor(d, key=key, learn=F.coalesce(F.crc32(key.cast("binary")) % 4 != 2, F.lit(False)), unlearned="")
    return docs.filter(predict(F.col(text_col).cast("string"))["lang_pred"] != "und")
