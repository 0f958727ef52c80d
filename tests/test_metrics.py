"""Figures of stages, in batch and in flight, against those of the finished table."""

from pyspark.sql import functions as F

from rasterloom.operators import metrics, requests
from rasterloom.scratch import written
from rasterloom.streaming.metrics import StageListener, watched_stream

STAGES = ["signup", "purchase", "never"]


def times(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    return requests.stage_times(events.select((F.col("user_id") % 100).alias("request_id"), F.col("event_type").alias("stage"), "ts"))


def plain(rows, stages=STAGES):
    out = {}
    for r in rows.collect():
        of = out.setdefault(r["stage"] if r["stage"] in stages else None, [])
        of.append(None if r["seconds"] is None else round(r["seconds"] * 1e6))
    return {s: (len(x), sum(y) if (y := [v for v in x if v is not None]) else None, max(y, default=None)) for s, x in out.items()}


def told(figures, spark):
    return {r["stage"]: tuple(r)[1:] for r in figures.table(spark).collect()}


def test_batch(spark, small):
    rows, figures = times(spark, small), metrics.StageFigures(STAGES)
    seen, observation = metrics.watched(rows, figures)
    assert written(seen).count() == rows.count()
    figures.add(observation.get)
    assert told(figures, spark) == plain(rows) and len(plain(rows)) == 3


def test_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1.5), ("a", None), (None, 2.0), ("b", None), ("b", None), ("z", 0.000001), ("a", 1.5)], "stage string, seconds double")
    for data in (rows, rows.where("false"), rows.where("stage is null")):
        for stages in (["a", "b", "a"], []):
            figures = metrics.StageFigures(stages)
            seen, observation = metrics.watched(data, figures)
            seen.write.format("noop").mode("overwrite").save()
            figures.add(observation.get)
            assert told(figures, spark) == plain(data, stages)


def test_stream_with_restart(spark, small, tmp_path):
    rows, figures = times(spark, small), metrics.StageFigures(STAGES)
    folder, out = str(tmp_path / "times"), str(tmp_path / "out")
    listener = StageListener(figures)
    spark.streams.addListener(listener)
    try:
        for part in range(3):  # each a run of its own from one checkpoint; the last one finds nothing new
            if part < 2:
                rows.where(F.pmod(F.hash("request_id", "stage"), F.lit(2)) == part).repartition(3).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
            query = watched_stream(stream, figures).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out)
            assert query.awaitTermination(120) and listener.wait(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    assert told(figures, spark) == plain(rows) == plain(spark.read.parquet(out))


def test_a_batch_counts_once():
    class Told(dict):
        def asDict(self):  # noqa: N802
            return dict(self)

    class Event:
        def __init__(self, query, batch, name="stages"):
            row = Told({f"{c}_{k}": 1 for k in range(2) for c in ("n", "micros", "longest")})
            self.progress = type("P", (), {"id": query, "batchId": batch, "name": None, "observedMetrics": {name: row}})()

    figures = metrics.StageFigures(["a"])
    listener = StageListener(figures)
    for event in (Event("q", 0), Event("q", 1), Event("q", 1), Event("r", 1), Event("q", 0), Event("q", 2, "others")):
        listener.onQueryProgress(event)
    assert figures._totals == {"a": (3, 3, 1), None: (3, 3, 1)}
    assert not listener.wait("never", 0.01)
