"""Figures of stages, taken while their rows pass: no job of their own, and no row reaches the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageFigures:
    """Of each named stage, and of all others together: how many rows have passed, their microseconds, and the longest.

    Rows are those of `requests.stage_times`: stage and seconds. Rows of other stages, or of none, count under null;
    null seconds count as rows alone. What is kept grows with the names, not with the rows.
    """

    def __init__(self, stages: list[str]) -> None:
        self.stages: list[str | None] = [*dict.fromkeys(stages), None]
        self._totals = {s: (0, None, None) for s in self.stages}

    def columns(self, stage: str = "stage", seconds: str = "seconds") -> list[Column]:
        """For `observe`, three of each stage."""
        micros = F.round(F.col(seconds) * 1_000_000).cast("long")
        named = F.coalesce(F.col(stage).isin(self.stages[:-1]), F.lit(False))
        out = []
        for k, name in enumerate(self.stages):
            here = ~named if name is None else F.col(stage).eqNullSafe(name)
            out += [F.count_if(here).alias(f"n_{k}"), F.sum(F.when(here, micros)).alias(f"micros_{k}"), F.max(F.when(here, micros)).alias(f"longest_{k}")]
        return out

    def add(self, figures: Mapping[str, int | None]) -> None:
        """Figures of a job or of a batch, under the names of `columns`."""
        for k, name in enumerate(self.stages):
            n, micros, longest = self._totals[name]
            given = [x for x in (micros, figures[f"micros_{k}"]) if x is not None]
            most = [x for x in (longest, figures[f"longest_{k}"]) if x is not None]
            self._totals[name] = (n + figures[f"n_{k}"], sum(given) if given else None, max(most, default=None))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, n, micros, longest) of the stages that had rows."""
        return spark.createDataFrame([(s, *t) for s, t in self._totals.items() if t[0]], "stage string, n long, micros long, longest long")


def watched(times: DataFrame, figures: StageFigures) -> tuple[DataFrame, Observation]:
    """The same rows, and what is told of them by the first job that reads them all: `figures.add(observation.get)`.

    Watch after the last shuffle, as here. A task before it that runs again for a lost executor tells its rows twice; one
    of a job's last tasks counts once however often it runs."""
    seen = Observation()
    return times.observe(seen, *figures.columns()), seen
