"""What the rounds of a run did, as a table: counted by the jobs of the rounds themselves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "step long, phase string, round long, changed long, left long"


@dataclass
class Record:
    """Rounds of the phases of one run. ``changed`` is what a round removed, reached or relabelled, ``left`` what stays to do: vertices that
    survive, or that have not been reached."""

    rows: list[tuple[int, str, int, int, int | None]] = field(default_factory=list)
    step: int = 1
    phase: str = ""

    def begin(self, step: int, phase: str) -> Record:
        self.step, self.phase = step, phase
        return self

    def add(self, round: int, changed: int, left: int | None = None) -> None:
        self.rows.append((self.step, self.phase, round, changed, left))

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, phase, round, changed, left): a row for each round, of which there are few."""
        return spark.createDataFrame(self.rows, SCHEMA)
