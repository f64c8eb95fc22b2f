"""The stage runner: named steps over a DataFrame, each timed and guarded."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enhance, record, score
from ..operators.store import stored


@dataclass
class Run:
    """Rows after the last stage, and of each stage its name, seconds, whether it went well, and a warning if not."""

    rows: DataFrame
    report: list[tuple[str, float, bool, str | None]] = field(default_factory=list)

    @property
    def warnings(self) -> list[str]:
        return [w for *_, w in self.report if w]

    def report_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.report, "stage string, seconds double, success boolean, warning string")


def run_stages(rows: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> Run:
    """Every stage's rows are written to the shared folder and read by the next, so that a failure shows in its own stage.

    A stage that fails, while planning or while running, leaves a warning; the next one works on the rows before it.
    """
    run = Run(rows)
    for name, stage in stages:
        begin = time.monotonic()
        try:
            run.rows, warning = stored(stage(run.rows), f"stage-{name}"), None
        except Exception as error:  # noqa: BLE001
            warning = f"Stage '{name}' failed: {error}"
        run.report.append((name, round(time.monotonic() - begin, 3), warning is None, warning))
    return run


def record_stages(as_of: str) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """From doc_id and text to repaired, validated and scored records."""
    return [
        ("extraction", lambda docs: record.extract(docs, as_of).join(docs, "doc_id")),
        ("enhancement", lambda rows: enhance.enhance(rows, as_of)),
        ("validation", lambda rows: enhance.validate_record(rows, as_of)),
        ("confidence", score.confidence),
        ("completeness", score.completeness),
    ]


def quick_extract(docs: DataFrame, as_of: str) -> DataFrame:
    """doc_id and record alone."""
    return run_stages(docs, record_stages(as_of)[:2]).rows.select("doc_id", F.col("record"))
