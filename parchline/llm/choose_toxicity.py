"""Chooses N_GRAMS and LEAST_Z of the toxicity classifier inside the rows that may be fitted.

``python -m parchline.llm.choose_toxicity FOLDER`` reads documents and labels of a folder of tables, leaves out the held-out part,
deals the rest into FOLDS parts by the digest of their first 60 bytes (so that near copies stay together), and prints the
mean balanced accuracy of every setting over the parts. Held-out rows are never read.
"""

from __future__ import annotations

import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np

from . import toxicity

FOLDS = 3
SETTINGS = [(grams, z) for grams in ((3, 5), (4, 6), (5, 7), (4, 5, 6, 7)) for z in (4.0, 5.0, 6.0)]


def rows(folder: str) -> list[tuple[bytes, int]]:
    import duckdb

    found = duckdb.execute(
        f"SELECT doc_id, text, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE length(text) BETWEEN 1 AND 20000 ORDER BY doc_id"
    ).fetchall()
    return [(t.encode(), y) for i, t, y in found if zlib.crc32(str(i).encode()) % toxicity.PARTS != toxicity.HELD_OUT]


def judged(job: tuple) -> tuple[tuple, float]:
    """Balanced accuracy of one setting on one part."""
    setting, fold, given = job
    toxicity.N_GRAMS, toxicity.LEAST_Z = setting
    part = np.array([zlib.crc32(t[:60]) % FOLDS for t, _ in given])
    fit = [r for r, k in zip(given, part) if k != fold]
    model = toxicity.fit([t for t, _ in fit], [y for _, y in fit])
    got = [(model.score(t) >= toxicity.THRESHOLD, y) for (t, y), k in zip(given, part) if k == fold]
    return setting, float(np.mean([np.mean([p == bool(y) for p, y in got if y == k]) for k in (0, 1)]))


def main(folder: str) -> None:
    given = rows(folder)
    scores: dict[tuple, list[float]] = {}
    with ProcessPoolExecutor() as pool:
        for setting, score in pool.map(judged, [(s, k, given) for s in SETTINGS for k in range(FOLDS)]):
            scores.setdefault(setting, []).append(score)
    for setting, each in sorted(scores.items(), key=lambda x: -np.mean(x[1])):
        print(setting, round(float(np.mean(each)), 4), [round(x, 4) for x in each])


if __name__ == "__main__":
    main(sys.argv[1])
