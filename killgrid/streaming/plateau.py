"""Attempts as a stream: running kills and the streak without gain, kept per task.

Null tasks are left out; an error neither gains nor counts as a try; a batch's attempts of a task are
taken in order of `attempt` (null ones first).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ATTEMPTS = "problem_id string, attempt long, status string, new_kills long"
PLATEAU = "problem_id string, attempt long, kills long, streak long, stopped boolean"


def read_attempts(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of the JSON lines that are added to a folder."""
    return spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", per_trigger).json(folder)


def plateaus(attempts: DataFrame, patience: int = 2) -> DataFrame:
    """One row per attempt with the task's kills and streak so far; stopped once the streak reaches patience."""
    least = max(1, patience)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kills, streak, over = state.get if state.exists else (0, 0, False)
        # a task's attempts are few: the batch's rows of one task are ordered together
        own = pd.concat(list(frames)).sort_values("attempt", na_position="first", kind="stable")
        rows = []
        for attempt, status, gain in zip(own["attempt"], own["status"], own["new_kills"], strict=True):
            gain = 0 if pd.isna(gain) else int(gain)
            if status != "ERROR":
                kills += gain
                streak = 0 if gain else streak + 1
                over = over or streak >= least
            rows.append((key[0], None if pd.isna(attempt) else int(attempt), kills, streak, over))
        state.update((kills, streak, over))
        yield pd.DataFrame(rows, columns=["problem_id", "attempt", "kills", "streak", "stopped"])

    grouped = attempts.where("problem_id IS NOT NULL").groupBy("problem_id")
    return grouped.applyInPandasWithState(run, PLATEAU, "kills long, streak long, stopped boolean", "append", "NoTimeout")
