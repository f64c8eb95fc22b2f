"""Quality rules: word statistics and compression bands.

Base counts (words are `[^\\x20\\x09-\\x0D]+`): n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words; base_failed where a text has fewer than 10 words or more than a fifth
of them in repeated 5-word windows.

Bands. The ratio of a text's bytes to its zstandard size must lie between limits that
depend on its length, for the whole text and for its fixed chunks of CHUNK bytes: above
the upper limit a text repeats itself, below the lower one it is noise. A text is rejected
when its whole, or more than CHUNK_SHARE of its chunks, falls outside. A rest of under
SHORTEST bytes belongs to the last chunk. Texts under SHORTEST bytes have no meaningful ratio and pass.

Defined results. Null and empty texts: all counts 0, base_failed true. Repeated rows and
null ids are judged row by row; extra columns are ignored. Very long texts are hashed by
parts and compressed as a stream whose output is only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, small_batches, to_bytes, window_hashes, with_id, word_hashes

LEVEL = 3
CHUNK = 4096
#: Bytes given to a compression stream at once.
FEED = 1 << 20
SHORTEST = 200
CHUNK_SHARE = 0.5
#: Length in bytes from which the limits hold, lowest and highest ratio allowed.
BANDS = (
    (200, 1.02, 3.2),
    (1_000, 1.2, 4.0),
    (5_000, 1.35, 5.0),
    (20_000, 1.45, 6.0),
    (100_000, 1.5, 7.0),
)
SYMBOLS = b"[#*$%&|<>]"[1:-1]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_START = np.array([b & 0xC0 != 0x80 for b in range(256)])
_COUNTED = _START & ~_SPACE


def limits(size: int) -> tuple[float, float]:
    """Lowest and highest ratio for a text of ``size`` bytes."""
    low, high = 0.0, float("inf")
    for least, a, b in BANDS:
        if size >= least:
            low, high = a, b
    return low, high


class Compressor:
    def __init__(self) -> None:
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, data: bytes) -> float:
        if len(data) <= FEED:
            return len(data) / len(self.zstd.compress(data))
        stream = self.zstd.compressobj(size=len(data))
        size = sum(len(stream.compress(data[i : i + FEED])) for i in range(0, len(data), FEED))
        return len(data) / (size + len(stream.flush()))

    def judge(self, text: bytes) -> tuple[float | None, int, int, bool]:
        """Whole ratio, chunks, chunks outside their band, verdict."""
        if len(text) < SHORTEST:
            return None, 0, 0, True
        whole = self.ratio(text)
        low, high = limits(len(text))
        ok = low <= whole <= high
        chunks = outside = 0
        count = max(1, (len(text) + CHUNK - SHORTEST) // CHUNK)
        for i in range(0, count * CHUNK, CHUNK):
            part = text[i : i + CHUNK] if i < (count - 1) * CHUNK else text[i:]
            low, high = limits(len(part))
            chunks += 1
            outside += not low <= self.ratio(part) <= high
        return whole, chunks, outside, ok and outside <= CHUNK_SHARE * chunks


def repeated_words(words: np.ndarray, k: int = 5) -> int:
    """Words covered by k-word windows that occur twice or more."""
    if len(words) < k:
        return 0
    windows = window_hashes(words, k)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = order[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


_SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, n_chunks bigint, n_chunks_outside bigint, band_ok boolean"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = Compressor()
    for batch in batches:
        texts = to_bytes(batch.column("text").to_pylist())
        rows = []
        for text, words in zip(texts, word_hashes(texts, lower=False)):
            buf = np.frombuffer(text, dtype=np.uint8)
            rows.append(
                (
                    len(words),
                    int(_COUNTED[buf].sum()),
                    int(_SYMBOL[buf].sum()),
                    duplicate_lines(text),
                    repeated_words(words),
                    *compressor.judge(text),
                )
            )
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.record_batch(
            {"doc_id": batch.column("doc_id")} | {n: pa.array(list(c), k) for n, c, k in zip(names, zip(*rows), kinds)}
            if rows
            else {"doc_id": batch.column("doc_id")} | {n: pa.array([], k) for n, k in zip(names, kinds)}
        )


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios, base_failed and kept of every row."""
    small_batches(df.sparkSession)
    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = given.mapInArrow(_rows, with_id(given, _SCHEMA))
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", F.expr("NOT base_failed AND band_ok"))
