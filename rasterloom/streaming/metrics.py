"""Figures of stages from streams in flight, batch by batch."""

from __future__ import annotations

import logging
import threading

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from rasterloom.operators.metrics import StageFigures

logger = logging.getLogger(__name__)


def watched_stream(times: DataFrame, figures: StageFigures, name: str = "stages") -> DataFrame:
    """The same rows (stage, seconds, and others), whose figures a `StageListener` of that name is told."""
    return times.observe(name, *figures.columns())


class StageListener(StreamingQueryListener):
    """Adds up what all streams tell under a name; for `spark.streams.addListener`.

    A batch that a query tells again, as after a restart from its checkpoint, counts once. Every batch is logged."""

    def __init__(self, figures: StageFigures, name: str = "stages") -> None:
        self.figures, self.name = figures, name
        self._last: dict[str, int] = {}  # batch of each query
        self._ended: set[str] = set()
        self._changed = threading.Condition()  # events come in threads of their own

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        told = progress.observedMetrics.get(self.name)
        if told is None:
            return
        with self._changed:
            if progress.batchId <= self._last.get(str(progress.id), -1):
                return
            self._last[str(progress.id)] = progress.batchId
            self.figures.add(told.asDict())
        logger.info("batch %s of %s: %s", progress.batchId, progress.name or progress.id, told.asDict())

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Until all that a run had to tell is told; events come after `awaitTermination` returns. False: not in time."""
        with self._changed:
            return self._changed.wait_for(lambda: run_id in self._ended, seconds)
