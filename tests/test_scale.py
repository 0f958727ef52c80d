"""Cases that grow: many paths, many ends of a run, many accesses at one time, and interlaced or filtered images."""

import json
import os
import pathlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import config
from rasterloom.functions import png
from rasterloom.operators import cache, patches, progress, workflow
from rasterloom.plans import catalogue
from rasterloom.sources.backend import fetch_results, remote_backend, submit_runs


def test_depths_of_a_ladder(spark):
    """Two ways at each of forty steps: as many paths as fit no machine."""
    pairs = [(f"{i}{a}", f"{i + 1}{b}") for i in range(40) for a in "xy" for b in "xy"]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    found = {r["node_id"]: r["depth"] for r in workflow.depths(edges, nodes).collect()}
    assert found == {f"{i}{a}": i for i in range(41) for a in "xy"}
    round_trip = edges.union(spark.createDataFrame([("41z", "1x"), ("40x", "41z")], edges.schema))
    with pytest.raises(ValueError, match="cycle"):
        workflow.depths(round_trip, nodes)
    assert {r["node_id"] for r in workflow.cycles(round_trip).collect()} == {f"{i}{a}" for i in range(1, 40) for a in "xy"} - {"1y"} | {"40x", "41z"}
    assert workflow.cycles(edges).collect() == []


def test_a_long_chain(spark, monkeypatch):
    """A chain of 5,000 nodes takes about as many rounds as its length has binary digits, forwards and back."""
    rounds = []
    keep = workflow.written
    monkeypatch.setattr(workflow, "written", lambda df: rounds.append(1) or keep(df))
    edges = spark.range(4999).selectExpr("id AS src", "id + 1 AS dst")
    found = workflow.depths(edges, spark.range(5000).withColumnRenamed("id", "node_id"))
    assert found.where("depth <> node_id").count() == 0 and found.count() == 5000 and len(rounds) <= 32
    alone = workflow.depths(edges.limit(0), spark.range(3).withColumnRenamed("id", "node_id"))
    assert [r["depth"] for r in alone.collect()] == [0, 0, 0]


def test_closure(spark):
    rnd = random.Random(7)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)}
    edges = spark.createDataFrame([*pairs, (None, 3), (4, None)], "src int, dst int")
    want = set(pairs)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in workflow.reach(edges).collect()} == want
    assert {r["node_id"] for r in workflow.cycles(edges).collect()} == {a for a, b in want if a == b}


def test_closure_makes_few_pairs(spark, monkeypatch):
    """Of a graph with many ways between two nodes, joins make a few pairs for each of the closure, not one for every
    node between; long ways double after the first steps."""
    made, keep = [], workflow._twice

    def counted(step, other):
        made.append(step.join(other.selectExpr("src AS dst", "dst AS to"), "dst").count())
        return keep(step, other)

    monkeypatch.setattr(workflow, "_twice", counted)
    edges = spark.range(2, 400).selectExpr("id AS src", "explode(array(id div 2, id div 3)) AS dst").where("dst > 0")
    monkeypatch.setattr(workflow, "MANY", 0)
    n = workflow.reach(edges).count()
    assert sum(made) < 3 * n
    made.clear()
    chain = spark.range(150).selectExpr("id AS src", "id + 1 AS dst")
    found = workflow.reach(chain, 4)
    assert found.count() == found.where("src < dst").count() == 150 * 151 // 2 and len(made) <= 16


def test_cycles_trim_trees_first(spark, monkeypatch):
    """Of a tree of a thousand nodes with one cycle, only what is near the cycle is walked by ways that double."""
    walked, keep = [], workflow._powers
    monkeypatch.setattr(workflow, "_powers", lambda pairs, nodes: walked.append(pairs.count()) or keep(pairs, nodes))
    tree = spark.range(2, 1000).selectExpr("id AS src", "id div 2 AS dst")
    back = spark.range(100, 101).selectExpr("id div 8 AS src", "id AS dst")
    assert {r["node_id"] for r in workflow.cycles(tree.union(back)).collect()} == {100, 50, 25, 12}
    assert walked[0] <= 10


def test_cycles_trim_trees_first(spark, monkeypatch):
    """Of a tree of a thousand nodes with one cycle, only what is near the cycle is walked by ways that double."""
    walked, keep = [], workflow._powers
    monkeypatch.setattr(workflow, "_powers", lambda pairs, nodes: walked.append(pairs.count()) or keep(pairs, nodes))
    tree = spark.range(2, 1000).selectExpr("id AS src", "id div 2 AS dst")
    back = spark.range(100, 101).selectExpr("id div 8 AS src", "id AS dst")
    assert {r["node_id"] for r in workflow.cycles(tree.union(back)).collect()} == {100, 50, 25, 12}
    assert walked[0] <= 10


def test_completion_of_many_ends(spark):
    rnd = random.Random(1)
    sent = [(f"p{rnd.randrange(3)}", rnd.randrange(100)) for _ in range(30)] + [("none", 5)]
    ends = [(f"p{rnd.randrange(3)}", rnd.randrange(90)) for _ in range(200)]
    at = lambda rows: spark.createDataFrame(rows, "prompt_id string, t long").select("prompt_id", F.timestamp_seconds("t").alias("ts"))
    messages = at(ends).withColumns({"type": F.lit("executing"), "node": F.lit(None).cast("string")})
    found = progress.completion(at(sent), messages).select("prompt_id", F.unix_seconds("ts").alias("t"), F.unix_seconds("done_at").alias("d")).collect()
    want = {(p, t, min((e for q, e in ends if q == p and e >= t), default=None)) for p, t in sent}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_accesses_at_one_time(spark, monkeypatch):
    """All of a log at two times, in slices of ten, whose states are worked out in groups of three."""
    monkeypatch.setattr(cache, "GROUP", 3)
    rnd = random.Random(2)
    rows = [(i, f"k{rnd.randrange(9)}", i // 250) for i in range(400)]
    log = spark.createDataFrame(rows, "n long, k string, t long").select("n", "k", F.timestamp_seconds("t").alias("at"))
    found = {r["n"]: r["hit"] for r in cache.replay_accesses(log, "k", "at", "n", 5, 10).collect()}
    held = []
    for n, k, _ in rows:
        assert found[n] == (k in held)
        held = ([x for x in held if x != k] + [k])[-5:]


@pytest.mark.parametrize(("kind", "depth", "samples"), [(0, 1, 1), (0, 8, 1), (2, 8, 3), (6, 16, 4)])
def test_interlaced(kind, depth, samples):
    rng = np.random.default_rng(kind)
    for width, height in ((1, 1), (3, 9), (21, 13)):
        v = rng.integers(0, 2 if depth == 1 else 256, (height, width, samples), dtype=np.uint8)
        body = b""
        for x0, y0, dx, dy in png.INTERLACED:
            part = v[y0::dy, x0::dx]
            for row in part if part.size else []:
                wide = np.packbits(row.ravel()) if depth == 1 else np.repeat(row.ravel(), depth // 8)
                body += b"\0" + wide.astype(np.uint8).tobytes()
        head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 1)
        data = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(body)) + png._chunk(b"IEND", b"")
        got = png.decode(data)
        assert (got[..., :samples] == (v * 255 if depth == 1 else v)).all() if samples > 1 else (got[..., 0] == v[..., 0] * (255 if depth == 1 else 1)).all()


def test_images_of_pixels(spark):
    """Pixels outside are left out, the largest of several counts, and broken bytes have no pixels."""
    dots = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 0, 9), (1, 3, 1, 7), (1, 4, 1, 8), (2, -1, 0, 8)], "id int, x int, y int, v int")
    made = patches.to_images(dots, 4, 2)
    assert [r["id"] for r in made.collect()] == [1]
    broken = made.union(spark.createDataFrame([(3, bytearray(b"x")), (4, None)], made.schema))
    found = patches.image_pixels(broken).where("r > 0").collect()
    assert sorted((r["id"], r["x"], r["y"], r["r"], r["g"], r["b"], r["a"]) for r in found) == [(1, 0, 0, 9, 9, 9, 255), (1, 3, 1, 7, 7, 7, 255)]


def test_settings_of_deployments(spark):
    given = spark.createDataFrame([("a", "port", "7"), ("a", "port", "6"), ("b", "other", "x"), ("b", None, None)], "site string, name string, value string")
    found = {r["site"]: r.asDict() for r in config.resolved(given, "site").collect()}
    plain = config.Settings()
    assert found["a"]["port"] == 7 and found["b"]["port"] == plain.port and found["b"]["http_url"] == plain.http_url and found["a"]["max_cache_bytes"] == plain.max_cache_bytes
    assert {k: found["b"][k] for k in ("source_dir", "sent_dir", "ws_url")} == {"source_dir": plain.source_dir, "sent_dir": plain.sent_dir, "ws_url": plain.ws_url}


IMAGE = {"outputs": {"1": {"images": [{"filename": "f", "subfolder": "", "type": "output"}]}}}


class Socket:
    """A connection that notes when it was opened and plays messages."""

    def __init__(self, url, messages, log):
        self.messages, self.log = iter(messages), log
        log(f"open {url.rpartition('clientId=')[2]}")

    def recv(self):
        return next(self.messages)

    def close(self):
        self.log("close")


def test_runs_are_waited_for_by_messages(spark, tmp_path):
    """The socket is open before a run is submitted, each request has its own client; other runs' ends, progress and
    binary messages are passed over."""
    folder = str(tmp_path)

    def log(line):
        with open(f"{folder}/calls", "a") as f:
            f.write(line + "\n")

    def send(method, url, body):
        if method == "POST":
            log("post " + json.loads(body)["client_id"])
            return 200, json.dumps({"prompt_id": json.loads(body)["prompt"]["case"]}).encode()
        if "/history/" in url:
            return 200, json.dumps({url.rpartition("/")[2]: IMAGE}).encode()
        return 200, b"image"

    def connect(url):
        assert url.startswith("ws://")
        frames = [("status", None, None), ("executing", "3", "good"), ("executing", None, "other"), ("executing", None, "good"), ("executing", None, "better")]
        return Socket(url, [b"binary", *(json.dumps({"type": kind, "data": {"node": node, "prompt_id": run}}) for kind, node, run in frames)], log)

    def lazy(url):
        log("open " + url)
        yield "{}"

    ready = spark.createDataFrame([("a", json.dumps({"case": "good"})), ("b", json.dumps({"case": "better"}))], "request_id string, workflow string").coalesce(1)
    settings = config.Settings()
    assert {bytes(r["result"]) for r in remote_backend(settings, send, connect=connect)(ready).collect()} == {b"image"}
    calls = (tmp_path / "calls").read_text().split("\n")
    clients = [c.split()[1] for c in calls if c.startswith("open")]
    assert len(set(clients)) == 2 and calls[:4] == [f"open {clients[0]}", f"post {clients[0]}", f"open {clients[1]}", f"post {clients[1]}"] and calls.count("close") == 2
    assert "messages stopped" in remote_backend(settings, send, connect=lambda url: Socket(url, [], log))(ready).first()["failed"]
    (tmp_path / "calls").write_text("")
    with pytest.raises(Exception, match="open connection"):
        remote_backend(settings, send, connect=lazy)(ready).collect()
    assert (tmp_path / "calls").read_text() == ""  # nothing was submitted to a socket that isn't open


def test_a_hundred_runs_at_once(spark, tmp_path):
    """One task submits all of its runs before it asks for any, and takes about as long as one of them."""
    folder = str(tmp_path)

    def send(method, url, body):
        case = json.loads(body)["prompt"]["case"] if method == "POST" else url.rpartition("/")[2]
        if method == "POST":
            (pathlib.Path(folder) / case).write_text(str(time.time() + 1))
            return 200, json.dumps({"prompt_id": case}).encode()
        if "/history/" in url:
            assert len(os.listdir(folder)) == 100
            return 200, json.dumps({case: IMAGE} if time.time() > float((pathlib.Path(folder) / case).read_text()) else {}).encode()
        return 200, b"image"

    ready = spark.createDataFrame([(i, json.dumps({"case": f"c{i}"})) for i in range(100)], "request_id int, workflow string").coalesce(1)
    found = remote_backend(config.Settings(), send, pause=0.1)(ready).collect()
    assert len(found) == 100 and all(bytes(r["result"]) == b"image" for r in found)


def test_steps_without_waiting(spark):
    def send(method, url, body):
        if method == "POST":
            case = json.loads(body)["prompt"]["case"]
            if case == "down":
                raise OSError("refused")
            return (200, json.dumps({"prompt_id": case}).encode()) if case != "bad" else (400, b"no")
        case = url.rpartition("/")[2]
        if "/history/" in url:
            return 200, json.dumps({} if case == "slow" else {case: IMAGE}).encode()
        return 200, b"image"

    ready = spark.createDataFrame([(c, json.dumps({"case": c})) for c in ("good", "slow", "bad", "down")], "request_id string, workflow string")
    sent = submit_runs(ready, config.Settings(), send).cache()
    got = {r["request_id"]: r for r in sent.collect()}
    assert [got[c]["prompt_id"] for c in ("good", "slow", "bad", "down")] == ["good", "slow", None, None] and len({r["client_id"] for r in got.values()}) == 4
    assert (got["bad"]["failed"], got["down"]["failed"]) == ("backend refused the run: no", "connection: refused") and all(r["ts"] for r in got.values())
    found = {r["request_id"]: r for r in fetch_results(sent.where("prompt_id is not null"), config.Settings(), send).collect()}
    assert bytes(found["good"]["result"]) == b"image" and found["slow"]["failed"] == "run slow hasn't ended" and len(found) == 2


def test_inpaint_draws_masks_once(spark, small):
    """The final plan reads what was written: of the functions on bytes only the patches' is left in it."""
    found = catalogue.inpaint_responses(spark, small)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("== Initial Plan ==")[0].count("ArrowEvalPython") == 1
