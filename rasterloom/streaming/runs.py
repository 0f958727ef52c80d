"""The life of submitted runs as stateful streaming: a run needs no task that waits for it.

Submissions and messages come as one stream, in any order. A run's state is when it was submitted, messages that came
before that was known, and what has been told of it. Timers in event time tell runs that stay silent and forget those
whose time is up, so state doesn't grow with what has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times are in microseconds since 1970; at is that of the message, or for silent runs their limit.
OUTCOME = "prompt_id string, outcome string, submitted_us long, at_us long"
#: What the state store must be for these operators.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_events(submitted: DataFrame, messages: DataFrame, failed: Column | None = None) -> DataFrame:
    """One stream (prompt_id, ts, event) of submissions (prompt_id, ts) and parsed messages (prompt_id, ts, type, node):
    `submitted`, `ended` and `failed`, by default for messages of type execution_error; other messages are left out."""
    end = (F.col("type") == "executing") & F.col("node").isNull()
    what = F.when(F.col("type") == "execution_error" if failed is None else failed, "failed").when(end, "ended")
    found = messages.select("prompt_id", "ts", what.alias("event")).where("prompt_id is not null and event is not null")
    return submitted.select("prompt_id", "ts", F.lit("submitted").alias("event")).where("prompt_id is not null").union(found)


class RunLife(StatefulProcessor):
    def __init__(self, limit_us: int, remember_us: int):
        self.limit, self.remember = limit_us, remember_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.submitted = handle.getValueState("submitted", "us long")
        self.told = handle.getValueState("told", "outcome string")
        self.early = handle.getMapState("early", "us long, event string", "n long")

    def _timer(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def _outcome(self, key: str, outcome: str, at: int) -> tuple:
        self.told.update((outcome,))
        return (key, outcome, self.submitted.get()[0], at)

    def _messages(self, key: str, messages: list[tuple]) -> list[tuple]:
        """The first end or failure within the limit counts; behind it the run was silent, and what comes is late.
        messages: (us, event) in order of time."""
        start, told, out = self.submitted.get()[0], self.told.get()[0] if self.told.exists() else None, []
        for us, event in messages:
            if us < start or told in ("ended", "failed", "late"):
                continue
            if us <= start + self.limit and told is None:
                told = event
            else:
                if told is None:
                    out.append((key, "silent", start, start + self.limit))
                told = "late"
            out.append((key, told, start, us))
        if out:
            self.told.update((told,))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        out: list[tuple] = []
        messages: set[tuple] = set()
        first = None
        for pdf in rows:
            messages |= {(us, e) for us, e in zip(pdf.us.tolist(), pdf.event.tolist(), strict=True) if e in ("ended", "failed")}
            sent = pdf.us[pdf.event == "submitted"]
            first = min(filter(None.__ne__, (first, int(sent.min()) if len(sent) else None)), default=None)
        known = self.submitted.get()[0] if self.submitted.exists() else None
        if first is not None and (known is None or first < known):
            self.submitted.update((first,))
            self._timer(first + self.limit)
            self._timer(first + self.limit + self.remember)
            if known is None:
                messages |= {tuple(k) for k in self.early.keys()}
                self.early.clear()
            known = first
        if known is not None:
            out = self._messages(key[0], sorted(messages))
        else:  # only what comes before its submission is kept
            for us, event in messages:
                self.early.updateValue((us, event), (1,))
                self._timer(us + self.remember)
        yield pd.DataFrame(out, columns=["prompt_id", "outcome", "submitted_us", "at_us"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        out, now = [], expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.submitted.exists():
            start = self.submitted.get()[0]
            if not self.told.exists() and now >= start + self.limit:
                out.append(self._outcome(key[0], "silent", start + self.limit))
            if now >= start + self.limit + self.remember:
                self.submitted.clear()
                self.told.clear()
                self.early.clear()
        else:
            for k in [tuple(k) for k in self.early.keys() if k[0] + self.remember <= now]:
                self.early.removeKey(k)
        yield pd.DataFrame(out, columns=["prompt_id", "outcome", "submitted_us", "at_us"])

    def close(self) -> None:
        pass


def run_outcomes(events: DataFrame, limit_seconds: float, remember_seconds: float, late: str = "0 seconds") -> DataFrame:
    """OUTCOME rows of a stream of `run_events`: of each run `ended` or `failed` at its first message at or after the
    submission, `silent` once the watermark has passed the limit without one, and `late` for the first message after
    that. A repeated submission counts as the first; a run is forgotten remember_seconds after its limit, and a message
    without a submission that long after its time. The state store must be ROCKSDB; nulls in prompt_id are left out."""
    rows = events.withWatermark("ts", late).select("prompt_id", "ts", F.unix_micros("ts").alias("us"), "event")
    life = RunLife(int(limit_seconds * 1_000_000), int(remember_seconds * 1_000_000))
    return rows.groupBy("prompt_id").transformWithStateInPandas(life, OUTCOME, "append", "EventTime")


def collected(stream: DataFrame, folder: str, checkpoint: str, timers: bool = False) -> DataFrame:
    """What a stream gives of all that is there by now, written to a folder; goes on from the checkpoint.

    timers: also what timers tell once the watermark has moved, for which Spark runs a batch without data. With
    availableNow it does so only for some sources, so then the stream runs until it has nothing left to do."""
    spark = stream.sparkSession
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        query = (writer if timers else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(ROCKSDB[0], before) if before else spark.conf.unset(ROCKSDB[0])
    if timers:
        query.processAllAvailable()
        query.stop()
    else:
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
