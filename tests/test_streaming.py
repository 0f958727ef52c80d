"""The frame source across restarts, and the states of runs across batches."""

import json

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import frames
from rasterloom.streaming import runs


def rows(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("c"), F.col("id") % 3).alias("channel"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("value"))


def values(spark, folder):
    return sorted(int(r["value"]) for r in spark.read.parquet(folder).collect())


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    """A query goes on where it ended, a batch that failed comes again as it was, and what is read may be dropped."""
    log, out, at = (str(tmp_path / n) for n in ("log", "out", "at"))
    assert frames.append_frames(rows(spark, 0, 50), log) == 0 and frames.append_frames(rows(spark, 50, 90), log) == 1
    runs.collected(frames.read_frames(spark, log, rowGroupsPerTask="1"), out, at)
    assert values(spark, out) == list(range(90))
    runs.collected(frames.read_frames(spark, log), out, at)
    assert values(spark, out) == list(range(90))
    frames.append_frames(rows(spark, 90, 130), log)
    (tmp_path / "log/0000000003").mkdir()  # a writer that didn't get to its end

    seen = []

    def broken(batch, number):
        seen.append((number, sorted(int(r["value"]) for r in batch.collect())))
        raise RuntimeError("lost")

    def right(batch, number):
        seen.append((number, sorted(int(r["value"]) for r in batch.collect())))

    for step in (broken, right, right):
        query = frames.read_frames(spark, log).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start()
        if step is broken:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination(60)
            frames.append_frames(rows(spark, 130, 140), log)  # comes after the batch that runs again, not in it
        else:
            query.awaitTermination(60)
    assert seen == [(0, list(range(130))), (0, list(range(130))), (1, list(range(130, 140)))]
    runs.collected(frames.read_frames(spark, log, dropCommitted="true"), out, at)
    runs.collected(frames.read_frames(spark, log, dropCommitted="true"), out, at)
    assert values(spark, out) == list(range(140)) and frames.append_frames(rows(spark, 140, 141), log) == 4
    runs.collected(frames.read_frames(spark, log, dropCommitted="true"), out, at)
    assert values(spark, out) == list(range(141))
    assert not (tmp_path / "log/0000000000").exists()
    with pytest.raises(FileNotFoundError, match="is gone"):
        frames._StreamReader({"path": log}).partitions({"segments": 0}, {"segments": 2})


def test_the_log_in_batch_and_empty(spark, tmp_path):
    spark.dataSource.register(frames.FrameSource)
    empty = spark.read.format("frames").load(str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == ["channel", "ts", "value"]
    frames.append_frames(rows(spark, 0, 0), str(tmp_path / "log"))
    frames.append_frames(rows(spark, 0, 5).union(spark.sql("SELECT NULL, NULL, NULL")), str(tmp_path / "log"))
    found = spark.read.format("frames").load(str(tmp_path / "log")).collect()
    assert sorted(str(r["value"]) for r in found) == ["0", "1", "2", "3", "4", "None"]


def test_runs_across_batches(spark, tmp_path):
    """Messages before their submission, repeated ones, silence that a timer tells, late ends, and what is forgotten."""
    log, out, at = (str(tmp_path / n) for n in ("log", "out", "at"))

    def message(second, run, kind, node=None):
        return ("c", second, json.dumps({"type": kind, "data": {"node": node, "prompt_id": run}}))

    batches = [
        [message(100, "a", "submitted"), message(105, "b", "executing"), message(103, "a", "executing", "7"), message(101, "quiet", "submitted"), message(102, "slow", "submitted"), message(90, None, "executing")],
        [message(110, "a", "executing"), message(104, "b", "submitted"), message(111, "a", "executing"), message(112, "bad", "submitted"), message(113, "bad", "execution_error"), message(114, "bad", "executing")],
        [message(180, "slow", "executing"), message(181, "slow", "executing"), message(130, "b", "submitted")],
        [message(2000, "last", "submitted")],
        [message(2001, "quiet", "executing"), message(2002, "last", "executing")],
    ]
    told = F.when(F.col("type") == "submitted", "submitted").when(F.col("type") == "execution_error", "failed").when((F.col("type") == "executing") & F.col("node").isNull(), "ended")
    from rasterloom.operators.progress import parse_messages

    for batch in batches:
        frames.append_frames(spark.createDataFrame(batch, "channel string, s int, value string").select("channel", F.timestamp_seconds("s").alias("ts"), "value"), log)
        events = parse_messages(frames.read_frames(spark, log)).select("prompt_id", "ts", told.alias("event")).where("event is not null and prompt_id is not null")
        runs.collected(runs.run_outcomes(events, 60, 300, "30 seconds"), out, at, timers=True)
    found = sorted((r["prompt_id"], r["outcome"], r["submitted_us"] // 10**6, r["at_us"] // 10**6) for r in spark.read.parquet(out).collect())
    assert found == [("a", "ended", 100, 110), ("b", "ended", 104, 105), ("bad", "failed", 112, 113), ("last", "ended", 2000, 2002), ("quiet", "silent", 101, 161), ("slow", "late", 102, 180), ("slow", "silent", 102, 162)]
