"""Quality: a byte-level convolutional network in numpy over whole documents.

FILTERS learned filters of WIDTH bytes run over every position of the text (one-hot
bytes, so a filter is WIDTH tables of 256 weights). Activations are max-pooled in
cells of CELL positions; overlapping chunks of CHUNK cells, STRIDE apart, cover the
whole text and average their rectified cells. The mean and the maximum of the chunks feed
one logistic unit. Adam fits all weights on the fitting sample; a parameter set
of about 40 kB is broadcast.

Defined results. Null and empty texts count as one blank and are scored as such. Repeated
rows and null ids are scored row by row; extra columns are ignored. Besides the text
itself PART cells are held, whatever its length. Without labelled rows of both kinds every text scores 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, to_bytes, with_id
from .labelled import SAMPLE_CHARS, SAMPLE_ROWS, apart, calibrate, fitting_sample

FILTERS, WIDTH = 8, 5
CELL, CHUNK, STRIDE = 16, 32, 24
PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Cells whose activations are held at once.
PART = 4096


class Model:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, shift: float):
        self.filters, self.bias, self.out, self.shift = filters, bias, out, shift
        self.scale, self.offset = 1.0, 0.0

    def cells(self, buf: np.ndarray) -> Iterator[np.ndarray]:
        """Rectified maxima of each cell of CELL positions, PART cells at a time."""
        n = max(1, len(buf) - WIDTH + 1)
        count = -(-n // CELL)
        for i in range(0, count, PART):
            k = min(PART, count - i)
            x = buf[i * CELL : (i + k) * CELL + WIDTH - 1]
            missing = k * CELL + WIDTH - 1 - len(x)
            if missing > 0:
                x = np.concatenate((x, np.zeros(missing, dtype=np.uint8)))
            h = self.filters[0][x[: k * CELL]]
            for j in range(1, WIDTH):
                h += self.filters[j][x[j : j + k * CELL]]
            yield np.maximum(h.reshape(k, CELL, FILTERS).max(axis=1) + self.bias, 0)

    def raw(self, text: bytes) -> float:
        """The logistic unit's sum. Chunks are averaged part by part; a part keeps the cells that the next one's chunks begin in."""
        held = np.zeros((0, FILTERS), dtype=np.float32)
        total, most, chunks = np.zeros(FILTERS), np.full(FILTERS, -np.inf), 0

        def take(starts: np.ndarray, ends: np.ndarray) -> None:
            nonlocal total, most, chunks
            sums = np.concatenate((np.zeros((1, FILTERS)), np.cumsum(held, axis=0, dtype=np.float64)))
            mean = (sums[ends] - sums[starts]) / (ends - starts)[:, None]
            total, most, chunks = total + mean.sum(axis=0), np.maximum(most, mean.max(axis=0)), chunks + len(mean)

        for part in self.cells(np.frombuffer(text or b" ", dtype=np.uint8)):
            held = np.concatenate((held, part))
            whole = max(0, (len(held) - CHUNK) // STRIDE)
            if whole:
                starts = np.arange(whole) * STRIDE
                take(starts, starts + CHUNK)
                held = held[whole * STRIDE :]
        starts = np.arange(0, max(1, len(held) - (CHUNK - STRIDE)), STRIDE)
        take(starts, np.minimum(starts + CHUNK, len(held)))
        return float(np.concatenate((total / chunks, most)) @ self.out + self.shift)

    def score(self, text: bytes) -> float:
        if not self.scale:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(text) + self.offset, -30, 30))))


def _crops(texts: list[bytes], rng: np.random.Generator, per: int) -> tuple[np.ndarray, np.ndarray]:
    """``per`` random chunks of each text as bytes, and how many cells of each are valid (0: no such chunk)."""
    size = CHUNK * CELL + WIDTH - 1
    x = np.zeros((len(texts), per, size), dtype=np.uint8)
    valid = np.zeros((len(texts), per), dtype=np.int64)
    for i, text in enumerate(texts):
        buf = np.frombuffer(text or b" ", dtype=np.uint8)
        count = -(-max(1, len(buf) - WIDTH + 1) // CELL)
        starts = np.arange(0, max(1, count - (CHUNK - STRIDE)), STRIDE)
        for j, s in enumerate(rng.permutation(starts)[:per]):
            part = buf[s * CELL : s * CELL + size]
            x[i, j, : len(part)] = part
            valid[i, j] = min(CHUNK, count - s)
    return x, valid


def fit(texts: list[bytes], labels: list[int], epochs: int = 6, per: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float64)
    params = [
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, dtype=np.float32),
        rng.normal(0, 0.3, 2 * FILTERS),
        np.zeros(1),
    ]
    model = Model(params[0], params[1], params[2], 0.0)
    if not (y == 0).any() or not (y == 1).any():
        model.scale = 0.0
        return model
    kept, other = apart(y)
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    first, second, step = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(kept)
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            grads = _gradients(params, *_crops([texts[r] for r in rows], rng, per), y[rows], balance[rows])
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                params[k] = (params[k] - move).astype(params[k].dtype)
    model = Model(params[0], params[1], params[2], float(params[3][0]))
    model.scale, model.offset = calibrate(np.array([model.raw(texts[i]) for i in other]), y[other].astype(int), THRESHOLD)
    return model


def _gradients(params, x, valid, y, balance):
    """Gradients of the weighted log loss by back-propagation through one batch of chunks."""
    filters, bias, out, shift = params
    b, c, _ = x.shape
    span = CHUNK * CELL
    flat = x.reshape(b * c, -1)
    h = filters[0][flat[:, :span]]
    for j in range(1, WIDTH):
        h += filters[j][flat[:, j : j + span]]
    h = h.reshape(b * c, CHUNK, CELL, FILTERS)
    arg = h.argmax(axis=2)
    top = np.take_along_axis(h, arg[:, :, None, :], axis=2)[:, :, 0, :] + bias
    mask = np.arange(CHUNK)[None, :, None] < valid.reshape(-1, 1, 1)
    live = (top > 0) & mask
    count = np.maximum(1, valid).reshape(-1, 1)
    chunk = ((top * live).sum(axis=1) / count).reshape(b, c, FILTERS)
    real = (valid > 0)[:, :, None]
    n = np.maximum(1, real.sum(axis=1))
    mean = (chunk * real).sum(axis=1) / n
    masked = np.where(real, chunk, -np.inf)
    best = masked.argmax(axis=1)
    most = np.take_along_axis(masked, best[:, None, :], axis=1)[:, 0, :]
    pooled = np.concatenate((mean, most), axis=1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ out + shift[0], -30, 30)))
    d = balance * (p - y) / b
    d_pooled = d[:, None] * out[None, :]
    d_chunk = real * (d_pooled[:, None, :FILTERS] / n[:, None, :])
    at = np.zeros_like(d_chunk)
    np.put_along_axis(at, best[:, None, :], d_pooled[:, None, FILTERS:], axis=1)
    d_top = ((d_chunk + at).reshape(b * c, 1, FILTERS) / count[:, :, None]) * live
    row, cell, f = np.nonzero(d_top)
    value = d_top[row, cell, f]
    place = cell * CELL + arg[row, cell, f]
    d_filters = np.stack(
        [
            np.bincount(flat[row, place + j].astype(np.int64) * FILTERS + f, value, 256 * FILTERS).reshape(256, FILTERS)
            for j in range(WIDTH)
        ]
    )
    return d_filters, d_top.sum(axis=(0, 1)), d @ pooled, np.array([d.sum()])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    return fit(*fitting_sample(docs, labels, "quality", PARTS, HELD_OUT, rows, chars))


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
