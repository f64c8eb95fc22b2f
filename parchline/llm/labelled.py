"""The bounded, documented sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled texts, none over so many characters, fit a classifier.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000


def fitting_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    parts: int,
    held_out: int,
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> tuple[list[bytes], list[int]]:
    """Texts and 0/1 labels of at most ``rows`` labelled rows outside the held-out part.

    A row is held out where crc32(doc_id as text) mod ``parts`` is ``held_out``. Rows
    are taken by a hash of their id, so the choice is the same on every run, half of
    them from each label where there are enough. Only ids, labels and hashes are
    sorted; texts are read for the chosen rows alone. An id with both labels fits nothing; of
    several texts of an id the smallest counts.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)")
        .where(f"crc32(cast(id AS string)) % {parts} <> {held_out}")
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("other"))
        .where("y = other")
        .drop("other")
    )
    order = [F.xxhash64("id"), "id"]
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(*order).limit(rows // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(f"char_length(text) BETWEEN 1 AND {chars}")
    got = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("id").toPandas()
    return [t.encode("utf-8", "replace") for t in got["text"]], [int(y) for y in got["y"]]


def apart(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit and rows that only calibrate: every eighth of each label, as sums over texts that were fitted are too sure of themselves.

    With under 16 rows of a label all rows do both.
    """
    order = np.concatenate([np.flatnonzero(y == k) for k in (0, 1)])
    rank = np.concatenate([np.arange((y == k).sum()) for k in (0, 1)])
    if min((y == 0).sum(), (y == 1).sum()) < 16:
        return order, order
    return np.sort(order[rank % 8 != 7]), order[rank % 8 == 7]


def calibrate(raw: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float]:
    """Scale and shift that turn raw sums into probabilities by a logistic curve.

    The scale comes from Newton steps on standardised sums, both labels weighted
    alike. The shift puts ``threshold`` at the cut with the best balanced accuracy,
    in the middle of the gap around it. Equal sums are never cut apart; where all are equal,
    none reaches the threshold.
    """
    mean, spread = raw.mean(), raw.std() or 1.0
    z = (raw - mean) / spread
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - y) * z).sum() + 1e-4 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-4, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    order = np.argsort(z)
    gain = np.concatenate(([0.0], np.cumsum(np.where(y[order] == 1, -w[order], w[order]))))[1:-1]
    apart = np.diff(z[order]) > 1e-9
    if not apart.any():
        return float(a / spread), float(np.log(threshold / (1 - threshold)) - a / spread * (z.max() * spread + mean) - 1)
    gain = np.where(apart, gain, -np.inf)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    best = best[np.argmax(z[order][best + 1] - z[order][best])]
    cut = (z[order][best] + z[order][best + 1]) / 2
    scale = a / spread
    return float(scale), float(np.log(threshold / (1 - threshold)) - scale * (cut * spread + mean))
