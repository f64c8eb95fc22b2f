"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the byte n-grams (N_GRAMS) of the text with A-Z in lower case and white space
folded, hashed to BUCKETS and counted in windows of WINDOW bytes. On the fitting sample each
bucket gets the log ratio of its smoothed frequencies in windows of toxic and other texts;
buckets whose two frequencies differ by less than LEAST_Z standard errors get none, as chance
explains them. A logistic regression with L2 penalty learns weights over the logarithms of
the counts, scaled by these ratios and by the window's length. Ratio and weight multiply
into one table of BUCKETS floats, which is broadcast (4 MB, whatever the data).

Scores see whole texts, and only texts. Texts toxic in one place only count as such: the
highest window counts. Sums are calibrated on labelled texts that were not fitted.

Defined results. Null and empty texts score the prior's side 0.0 (predicted 0). Repeated rows and null ids
are scored row by row; a null id is held out never (its remainder is null: false).
Extra columns of the input are ignored. Without labelled rows of both kinds every text scores 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, to_bytes, with_id
from .labelled import SAMPLE_CHARS, SAMPLE_ROWS, apart, calibrate, fitting_sample

N_GRAMS = (3, 5)
BITS = 20
BUCKETS = 1 << BITS
WINDOW = 2048
#: Sums of windows are taken for this many bytes; shorter ones than that count for less.
UNIT = 500
#: Chosen, like N_GRAMS, by choose_toxicity.py inside the rows that may be fitted.
#: Buckets seen in fewer fitted windows, or whose frequencies differ by fewer standard errors, have no weight.
LEAST_WINDOWS, LEAST_Z = 3, 5.0
PARTS, HELD_OUT = 3, 1
THRESHOLD = 0.7

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
#: Odd factors whose products' high bits spread the n-grams of 3 to 8 bytes, packed into 64-bit words, over the buckets.
_FACTOR = {k: np.uint64(x) for k, x in zip(range(3, 9), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9E3779B97F4A7C15, 0x8EBC6AF09C88C6E3, 0xD6E8FEB86659FD93, 0x589965CC75374CC3))}
#: Starts of n-grams hashed at once.
PIECE = 64 * WINDOW


def grams(text: bytes, useful: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, bucket) of all useful n-grams of a text with a blank before and after, in pieces of whole windows.

    An n-gram belongs to the window that it starts in.
    """
    buf = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    for at in range(0, len(buf), PIECE):
        part = buf[at : at + PIECE + max(N_GRAMS) - 1]
        one = part.astype(np.uint64)
        packed = {}
        for k in N_GRAMS:
            if len(part) >= k:
                packed[k] = one[: len(one) - k + 1].copy()
                for i in range(1, k):
                    packed[k] |= one[i : len(one) - k + 1 + i] << np.uint64(8 * i)
        starts, buckets = [], []
        for k, word in packed.items():
            bucket = ((word[:PIECE] * _FACTOR[k]) >> np.uint64(64 - BITS)).view(np.int64)
            found = np.flatnonzero(useful[bucket]) if useful is not None else np.arange(len(bucket))
            starts.append(found)
            buckets.append(bucket[found])
        if starts:
            yield (np.concatenate(starts) + at) // WINDOW, np.concatenate(buckets)


def windows(text: bytes) -> int:
    return -(-(len(text) + 2) // WINDOW)


def counts(text: bytes, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows and their useful buckets, each pair once, and the logarithms of their counts by length."""
    keys = [w * BUCKETS + b for w, b in grams(text, useful)]
    keys, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    window, bucket = keys // BUCKETS, keys % BUCKETS
    length = np.minimum(WINDOW, len(text) + 2 - window * WINDOW)
    return window, bucket, np.log1p(n) * (UNIT / (UNIT + length))


class Model:
    def __init__(self, table: np.ndarray, scale: float, shift: float):
        self.table, self.scale, self.shift = table, scale, shift
        self.useful = table != 0

    def raw(self, text: bytes) -> float:
        """The highest window's sum of weights."""
        window, bucket, value = counts(text, self.useful)
        return float(np.bincount(window, self.table[bucket] * value, windows(text)).max())

    def score(self, text: bytes) -> float:
        if not text or not self.scale:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(text) + self.shift, -30, 30))))


def log_count_ratios(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's frequency in windows of toxic and other texts; 0 where chance may explain it."""
    seen, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for text, k in zip(texts, y):
        for w, b in grams(text):
            np.add.at(seen[k], np.unique(w * BUCKETS + b) % BUCKETS, 1)
        n[k] += windows(text)
    ratio = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    both = seen.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    sure = np.abs(seen[1] / n[1] - seen[0] / n[0]) >= LEAST_Z * error
    return np.where(sure & (seen.sum(axis=0) >= LEAST_WINDOWS), ratio, 0.0)


def fit(texts: list[bytes], labels: list[int], epochs: int = 20, penalty: float = 1e-4, seed: int = 3) -> Model:
    """Log-count ratios, then logistic regression on the scaled features by adaptive stochastic gradients."""
    y = np.array(labels, dtype=np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0)
    kept, other = apart(y)
    ratio = log_count_ratios([texts[i] for i in kept], y[kept])
    useful, given = ratio != 0, []
    for i in kept:
        window, bag, value = counts(texts[i], useful)
        cuts = np.searchsorted(window, np.arange(1, windows(texts[i])))
        pairs = zip(np.split(bag.astype(np.int32), cuts), np.split((ratio[bag] * value).astype(np.float32), cuts))
        given += [(b, x, y[i]) for b, x in pairs]
    toxic = sum(k for _, _, k in given)
    balance = [len(given) / (2 * (len(given) - toxic)), len(given) / (2 * toxic)]
    weight, bias = np.ones(BUCKETS), 0.0
    rng = np.random.default_rng(seed)
    square = np.full(BUCKETS, 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(len(given)):
            bag, x, k = given[i]
            p = 1 / (1 + np.exp(-np.clip(weight[bag] @ x + bias, -30, 30)))
            g = balance[k] * (p - k)
            slope = g * x + penalty * weight[bag]
            square[bag] += slope**2
            weight[bag] -= 0.1 * slope / np.sqrt(square[bag])
            bias -= 0.01 * g
    model = Model((ratio * weight).astype(np.float32), 1.0, 0.0)
    raw = np.array([model.raw(texts[i]) for i in other])
    return Model(model.table, *calibrate(raw, y[other], THRESHOLD))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    return fit(*fitting_sample(docs, labels, "toxic", PARTS, HELD_OUT, rows, chars))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t) for t in to_bytes(batch.column("text").to_pylist())]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = given.mapInArrow(run, with_id(given, "score double"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
