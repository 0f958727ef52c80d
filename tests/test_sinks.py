"""Effects of repeated batches, and a folder's listing with pushed filters."""

import os

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import listing
from rasterloom.streaming import sinks


def test_effects_happen_once(spark, tmp_path):
    done, manifest = [], f"file://{tmp_path}/m"
    work = sinks.once(lambda batch, number: done.append((number, batch.count())), manifest)
    for number, n in ((0, 3), (1, 4), (1, 9), (0, 9), (2, 0)):
        work(spark.range(n), number)
    assert done == [(0, 3), (1, 4), (2, 0)] and sorted(os.listdir(tmp_path / "m")) == [f"{k:012d}" for k in range(3)]

    def broken(batch, number):
        raise RuntimeError("disk full")

    with pytest.raises(RuntimeError):
        sinks.once(broken, manifest)(spark.range(1), 3)
    assert not (tmp_path / "m/000000000003").exists()  # comes again
    sinks.once(broken, manifest, swallow=True)(spark.range(1), 3)
    assert (tmp_path / "m/000000000003").read_text() == "failed: disk full"


def test_last_inputs_and_deletions_of_a_stream(spark, tmp_path):
    rows = [(f"in/{i}.{'png' if i % 2 else 'jpeg'}", bytearray(b"image%d" % i), bytearray(b"mask%d" % i), i) for i in range(5)]
    folder = tmp_path / "rows"
    for k in (rows[:3], rows[3:]):
        spark.createDataFrame(k, "path string, content binary, mask binary, s int").select("path", "content", "mask", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("path string, content binary, mask binary, ts timestamp").parquet(str(folder))
        for _ in range(2):  # the second time with a checkpoint that is lost, so that batches come again under their numbers
            query = stream.writeStream.foreachBatch(sinks.keep_last_sent(str(tmp_path / "sent"), str(tmp_path / "m"))).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
            query.awaitTermination(60)
    assert {f: (tmp_path / "sent" / f).read_bytes() for f in os.listdir(tmp_path / "sent")} == {"last_sent_image.jpeg": b"image4", "last_sent_mask.png": b"mask4"} | ({"last_sent_image.png": b"image3"} if (tmp_path / "sent/last_sent_image.png").exists() else {})
    gone = [str(tmp_path / "sent" / f) for f in os.listdir(tmp_path / "sent")] + [str(tmp_path / "never")]
    batch = spark.createDataFrame([(p,) for p in gone], "path string")
    for _ in range(2):
        sinks.delete_evicted(str(tmp_path / "d"))(batch, 0)
        assert os.listdir(tmp_path / "sent") == []
        (tmp_path / "sent/later").write_text("x") if _ == 0 else None
        batch = spark.createDataFrame([(str(tmp_path / "sent/later"),)], "path string") if _ == 0 else batch
        if _ == 0:
            sinks.delete_evicted(str(tmp_path / "d"))(batch, 0)  # the batch's number is known: nothing is deleted
            assert os.listdir(tmp_path / "sent") == ["later"]
            sinks.delete_evicted(str(tmp_path / "d"))(batch, 1)


def test_listing(spark, tmp_path):
    for n in ("a.png", "a.jpeg", ".hidden", "_under.x", "b", "c.d.png"):
        (tmp_path / n).write_bytes(b"x" * len(n))
    (tmp_path / "folder.dir").mkdir()
    os.utime(tmp_path / "a.png", (2000, 2000))
    os.utime(tmp_path / "a.jpeg", (1000, 1000))
    found = listing.list_folder(spark, str(tmp_path), entriesPerTask="2")
    assert found.rdd.getNumPartitions() == 4
    assert {r["name"]: (r["source_id"], r["is_folder"], r["length"]) for r in found.collect()} == {p.name: (p.stem, p.is_dir(), None if p.is_dir() else p.stat().st_size) for p in tmp_path.iterdir()}
    kept = {r["source_id"]: r["path"] for r in listing.index(found).collect()}
    assert kept["a"] == str(tmp_path / "a.png") and set(kept) == {"a", ".hidden", "_under", "b", "c.d", "folder"}
    for test, names in ((F.col("name") == "b", {"b"}), (F.col("source_id").isin("a", "b"), {"a.png", "a.jpeg", "b"}), (F.col("name").startswith("a."), {"a.png", "a.jpeg"}), (F.col("name").endswith(".png"), {"a.png", "c.d.png"}), (F.col("length") > 5, {".hidden", "a.jpeg", "_under.x", "c.d.png"})):
        some = listing.list_folder(spark, str(tmp_path)).where(test)
        assert {r["name"] for r in some.collect()} == names
    assert {r["name"] for r in listing.list_folder(spark, str(tmp_path), glob="*.png").collect()} == {"a.png", "c.d.png"}
    reader = listing._Reader({"path": str(tmp_path)})
    assert list(reader.pushFilters([listing.EqualTo(("name",), "b"), listing.EqualTo(("length",), 1)])) == [listing.EqualTo(("length",), 1)]
    assert [r[1] for p in reader.partitions() for r in p.rows] == ["b"]
    plan = listing.list_folder(spark, str(tmp_path)).where("name = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan.replace("RuntimeFilters", "")  # nothing is left for Spark to filter
    assert listing.list_folder(spark, str(tmp_path / "none")).count() == 0
