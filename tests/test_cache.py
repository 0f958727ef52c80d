"""The cache's documented behaviour, batch against stream, and the parallel replay against a plain model."""

import os
import random
import time
from collections import OrderedDict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.operators import cache
from rasterloom.operators.lru import LruState
from rasterloom.schemas import CACHE_OPERATION
from rasterloom.sources.blobs import delete_blobs, read_blobs, write_blobs
from rasterloom.streaming.cache import stream_replay


def run(ops, files=3, size=100):
    state = LruState(files, size)
    return [state.apply(*op) for op in ops], state


def test_count_and_order():
    out, state = run([("add", "a", ".png", 1), ("add", "b", ".png", 1), ("add", "c", ".png", 1), ("get", "a"), ("add", "d", ".png", 1)])
    assert out[-1] == [("b", "evicted_count", "b.png"), ("d", "added", "d.png")]
    assert list(state.entries) == ["c", "a", "d"]


def test_limits_come_before_the_write():
    out, state = run([("add", "a", ".png", 90), ("add", "b", ".png", 90), ("add", "c", ".png", 5)])
    assert out[1] == [("b", "added", "b.png")]  # 180 bytes now: the incoming size didn't count
    assert out[2] == [("a", "evicted_size", "a.png"), ("c", "added", "c.png")]
    out, state = run([("add", "a", ".png", 100), ("add", "b", ".png", 1)])
    assert out[1] == [("b", "added", "b.png")]  # as much as the limit is not over it


def test_adding_again():
    out, state = run([("add", x, ".png", 1) for x in "abc"] + [("add", "c", ".png", 1)])
    assert list(state.entries) == ["b", "c"]  # one less than the limit
    out, state = run([("add", x, ".png", 1) for x in "abc"] + [("add", "a", ".png", 1)])
    assert list(state.entries) == ["b", "c", "a"]  # it was the oldest itself


def test_orphans_count_and_stay():
    out, state = run([("add", "a", ".png", 60), ("add", "a", ".jpg", 60), ("add", "b", ".png", 1)], files=9)
    assert state.orphans == {"a.png": 60} and out[2] == [("a", "evicted_size", "a.jpg"), ("b", "added", "b.png")]
    out, state = run([("add", "a", ".png", 100), ("add", "a", ".jpg", 1), ("add", "b", ".png", 5), ("add", "c", ".png", 5)], files=9)
    # an orphan as large as the limit empties the cache on every add, and can't be evicted itself
    assert list(state.entries) == ["c"] and state.disk == 105


def test_no_files_allowed():
    out, state = run([("add", "a", ".png", 1)], files=0)
    assert out == [[("a", "failed", "")]] and not state.entries


def test_lost_files():
    out, state = run([("add", "a", ".png", 1), ("lost", "a"), ("get", "a"), ("get", "a"), ("get", "z")])
    assert [o[0][1] if o else None for o in out] == ["added", None, "stale", "miss", "miss"]
    # a lost file stops eviction by size after it has been dropped
    out, state = run([("add", "a", ".png", 60), ("add", "b", ".png", 60), ("lost", "a"), ("add", "c", ".png", 60), ("add", "d", ".png", 1)], files=9)
    assert out[4] == [("d", "added", "d.png")] and list(state.entries) == ["b", "c", "d"]


def test_state_round_trip():
    _, state = run([("add", "a", ".png", 60), ("add", "a", ".jpg", 60), ("lost", "a")])
    assert LruState.from_json(state.to_json(), 3, 100) == state
    with pytest.raises(ValueError):
        state.apply("drop", "a")


def operations(spark, n=300, caches=3):
    rnd = random.Random(5)
    rows = [(f"c{rnd.randrange(caches)}", i, rnd.choice(["get", "get", "add", "lost"]), f"s{rnd.randrange(9)}", rnd.choice([".png", ".jpg"]), rnd.randrange(40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, CACHE_OPERATION)


def model(rows, files, size):
    states, out = {}, []
    for c, seq, op, key, ext, n in sorted(rows, key=lambda r: r[1]):
        out += [(c, seq, op, *x) for x in states.setdefault(c, LruState(files, size)).apply(op, key, ext, n)]
    return sorted(out)


def test_batch_and_stream(spark, tmp_path):
    rows, df = operations(spark)
    assert sorted(map(tuple, cache.replay(df, 4, 90).collect())) == model(rows, 4, 90)
    for k in range(3):
        df.where((F.col("seq") >= k * 100) & (F.col("seq") < (k + 1) * 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(CACHE_OPERATION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_replay(stream, 4, 90).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("replayed").collect())) == model(rows, 4, 90)


def test_sliced_replay(spark):
    rnd = random.Random(2)
    log = [(i, rnd.randrange(0, 2000), rnd.choice(["a", "b", "c", None, *map(str, range(12))])) for i in range(700)]
    df = spark.createDataFrame(log, "n long, at int, k string").withColumn("at", F.timestamp_seconds("at"))
    held, want = OrderedDict(), {}
    for n, _, k in sorted(log, key=lambda r: (r[1], r[0])):
        want[n] = k in held
        held.pop(k, None)
        held[k] = 1
        if len(held) > 5:
            held.popitem(last=False)
    for rows in (50, 10_000):
        found = cache.replay_accesses(df, "k", "at", "n", 5, rows)
        assert {r["n"]: r["hit"] for r in found.collect()} == want
    assert cache.replay_accesses(df.limit(0), "k", "at", "n", 5).count() == 0


def test_folder(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    write_blobs(spark.createDataFrame([("a.png", bytearray(b"one")), ("a.jpg", bytearray(b"three")), ("b.png", bytearray(b"22"))], "name string, content binary"), folder)
    for i, name in enumerate(["a.png", "b.png", "a.jpg"]):
        os.utime(f"{folder}/{name}", (1000 + i, 1000 + i))
    index = {r["source_id"]: r for r in cache.blob_index(spark, folder).collect()}
    assert index["a"]["path"].endswith("a.jpg") and index["a"]["length"] == 5 and index["a"]["position_at"] < index["b"]["position_at"]
    assert "content" not in cache.blob_index(spark, folder)._jdf.queryExecution().executedPlan().toString()
    delete_blobs(spark, read_blobs(spark, folder).where("path like '%a.png'"))
    assert sorted(os.listdir(folder)) == ["a.jpg", "b.png"]
    with pytest.raises(Exception, match="plain file name"):
        write_blobs(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary"), folder)


def test_folders_in_a_folder(spark, tmp_path):
    """A table of several files is one entry; hidden files aren't any."""
    folder = tmp_path / "with space"
    for i, name in enumerate(["a.png", "t.parquet/part-0", "t.parquet/k=1/part-1", "t.parquet/_SUCCESS", ".hidden", "t.old"]):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x" * (i + 1))
        os.utime(folder / name, (2000 - i, 2000 - i))
    for at in (str(folder), f"file://{folder}/"):
        index = {r["source_id"]: (r["path"].rpartition("/")[2], r["length"], r["last_access"].timestamp(), r["position_at"].timestamp()) for r in cache.blob_index(spark, at).collect()}
        assert index == {"a": ("a.png", 1, 2000, 2000), "t": ("t.parquet", 5, 1999, 1995)}


class PlainCache:
    """The described behaviour over a pretended folder, step by step."""

    def __init__(self, files, size):
        self.files, self.size, self.order, self.folder = files, size, OrderedDict(), {}

    def get(self, key):
        path = self.order.get(key)
        if path is None:
            return "miss"
        if path not in self.folder:
            del self.order[key]
            return "stale"
        self.order.move_to_end(key)
        return "hit"

    def add(self, key, extension, length):
        while len(self.order) >= self.files:
            if not self.order:
                return "failed"
            self.folder.pop(self.order.popitem(last=False)[1], None)
        total = sum(self.folder.values())
        while total > self.size and self.order:
            path = self.order.popitem(last=False)[1]
            if path not in self.folder:
                break
            total -= self.folder.pop(path)
        self.folder[key + extension] = length
        self.order[key] = key + extension
        self.order.move_to_end(key)
        return "added"


@settings(max_examples=300, deadline=None)
@given(
    st.integers(0, 4), st.integers(0, 120),
    st.lists(st.tuples(st.sampled_from(["get", "add", "lost"]), st.sampled_from("abcde"), st.sampled_from([".p", ".j"]), st.integers(0, 70)), max_size=40),
)
def test_any_sequence(files, size, ops):
    state, plain = LruState(files, size), PlainCache(files, size)
    for op, key, extension, length in ops:
        got = state.apply(op, key, extension, length)
        if op == "get":
            assert got[0][1] == plain.get(key)
        elif op == "add":
            assert got[-1][1] == plain.add(key, extension, length)
        elif key in plain.order:
            plain.folder.pop(plain.order[key], None)
        assert {k: p for k, (p, _) in state.entries.items()} == dict(plain.order) and list(state.entries) == list(plain.order)
        assert state.disk == sum(plain.folder.values())
