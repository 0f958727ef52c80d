import base64
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.config import Settings
from rasterloom.functions import png
from rasterloom.operators import progress, requests, workflow
from rasterloom.schemas import INPAINT_REQUEST
from rasterloom.sources.backend import remote_backend, view_url
from rasterloom.streaming.progress import finished_runs, read_messages, runs_with_timeout

TEMPLATE = {
    "1": {"inputs": {"name": "m.bin"}, "class_type": "Load", "_meta": {"title": "L"}},
    "7": {"inputs": {"text": 'good "q"\n', "clip": ["1", 1]}, "class_type": "Text", "_meta": {"title": "P"}},
    "8": {"inputs": {"text": "", "clip": ["1", 1]}, "class_type": "Text", "_meta": {"title": "N"}},
    "30": {"inputs": {"image": "x"}, "class_type": "Image", "_meta": {"title": "S"}},
    "47": {"inputs": {}, "class_type": "Image", "_meta": {"title": "M"}},
    "28": {"inputs": {"seed": 1, "cfg": 1.5000000000000002, "ok": True, "a": ["7", 0], "b": ["8", 0], "c": ["30", 0], "d": ["47", 1]}, "class_type": "Run", "_meta": {"title": "R"}},
}


def document(spark, value=TEMPLATE):
    return workflow.nodes(spark.createDataFrame([(json.dumps(value),)], "text string"))


def test_relations(spark):
    nodes = document(spark)
    assert [r["node_id"] for r in nodes.orderBy("pos").collect()] == list(TEMPLATE)
    edges = workflow.edges(nodes)
    assert sorted((r["src"], r["slot"], r["dst"]) for r in edges.collect()) == sorted([("1", 1, "7"), ("1", 1, "8"), ("7", 0, "28"), ("8", 0, "28"), ("30", 0, "28"), ("47", 1, "28")])
    assert workflow.literals(nodes).count() == 7
    assert {r["node_id"]: r["depth"] for r in workflow.depths(edges, nodes).collect()} == {"1": 0, "30": 0, "47": 0, "7": 1, "8": 1, "28": 2}
    assert [r["node_id"] for r in workflow.sinks(edges, nodes).collect()] == ["28"] and workflow.dangling(edges, nodes).count() == 0
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        workflow.nodes(spark.createDataFrame([("{no",)], "text string")).collect()


def test_bind(spark, tmp_path):
    rows = spark.createDataFrame([(1, "d\\s.png", "m\\k.png", 'a "b"', "bad\n", 5), (2, "s", "m", "", "", 2**60)], "i int, source_path string, mask_path string, prompt string, negative_prompt string, seed long")
    (tmp_path / "w.json").write_text(json.dumps(TEMPLATE, indent=1))
    text = workflow.read_workflow(spark, str(tmp_path / "w.json")).first()["text"]
    one, two = (json.loads(r["workflow"]) for r in workflow.bind(rows, text).orderBy("i").collect())
    assert list(one) == list(TEMPLATE)
    want = json.loads(json.dumps(TEMPLATE))
    want["28"]["inputs"]["seed"], want["7"]["inputs"]["text"], want["8"]["inputs"]["text"] = 5, 'a "b", good "q"\n', "bad\n"
    want["30"]["inputs"]["image"], want["47"]["inputs"]["image"] = "d/s.png", "m/k.png"
    assert one == want
    assert two["28"]["inputs"]["seed"] == 2**60 and two["7"]["inputs"]["text"] == 'good "q"\n' and two["8"]["inputs"]["text"] == ""
    lacking = {k: v for k, v in TEMPLATE.items() if k != "47"} | {"8": {"inputs": {}, "class_type": "Text"}}
    bound = workflow.bind(rows, json.dumps(lacking)).collect()
    assert {r["error"] for r in bound} == {"template lacks node 47, node 8 input text"}


def test_progress(spark, tmp_path):
    frames = ['{"type":"status","data":{}}', '{"type":"executing","data":{"node":"3","prompt_id":"p"}}', '{"type":"executing","data":{"node":null,"prompt_id":"p"}}', '{"type":"executing","data":{"node":null,"prompt_id":"q"}}', None, "{broken"]
    rows = spark.createDataFrame([(f,) for f in frames], "value string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    ends = progress.parse_messages(rows).where(progress.is_end())
    assert sorted(r["prompt_id"] for r in ends.collect()) == ["p", "q"]
    submitted = spark.createDataFrame([("p", 1), ("r", 1), ("q", 9)], "prompt_id string, ts int").withColumn("ts", F.timestamp_seconds("ts"))
    done = {r["prompt_id"]: r["done_at"] for r in progress.completion(submitted, progress.parse_messages(rows)).collect()}
    assert done["p"] and done["r"] is None and done["q"] is None
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(f for f in frames if f))
    (tmp_path / "in/b.txt").write_text(frames[2])
    q = finished_runs(read_messages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["prompt_id"] for r in spark.table("ends").collect()) == ["p", "q"]


def test_first_images(spark):
    image = {"filename": "f", "subfolder": "s", "type": "output"}
    cases = {"a": {"a": {"outputs": {"9": {"n": 1}, "5": {"images": [image, {}]}, "1": {"images": [{"filename": "z"}]}}}}, "b": {"b": {"outputs": {"1": {"images": []}}}}, "c": {"c": {"outputs": {}}}, "d": {}}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "prompt_id string, history string")
    got = {r["prompt_id"]: r for r in progress.first_images(rows).collect()}
    assert (got["a"]["filename"], got["a"]["subfolder"], got["a"]["type"], got["a"]["error"]) == ("f", "s", "output", None)
    assert [got[k]["error"] for k in "bcd"] == ["empty list of images", "no output images", "history has no such run"]


def test_inpaint(spark):
    rng = np.random.default_rng(0)
    image, mask = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8), np.zeros((40, 60), np.uint8)
    mask[20, 30] = 200
    m = base64.b64encode(png.encode(mask)).decode()
    rows = [(1, "s", "p", None, m, None), (2, "gone", "p", None, m, 3), (3, "s", "p", None, "QQ=", 3), (4, "s", "p", None, base64.b64encode(b"zz").decode(), 3), (5, "s", None, None, m, 3), (6, "down", "p", "n", m, 3), (7, "odd", "p", "n", m, 3)]
    asked = spark.createDataFrame([(*r, 60) for r in rows], "request_id int, " + INPAINT_REQUEST + ", ts int").withColumn("ts", F.timestamp_seconds("ts"))
    sources = spark.createDataFrame([(s, f"c/{s}.png") for s in ("s", "down", "odd")], "source_id string, path string")
    contents = spark.createDataFrame([("s", bytearray(png.encode(image))), ("odd", bytearray(b"not an image"))], "source_id string, content binary")

    def backend(ready):
        out = requests.echo_backend(contents)(ready)
        return out.withColumn("failed", F.when(F.col("failed").isNotNull(), "connection: refused"))

    got = {r["request_id"]: r for r in requests.inpaint(asked, sources, json.dumps(TEMPLATE), backend).collect()}
    assert [got[i]["status_code"] for i in range(1, 8)] == [200, 404, 500, 500, 422, 502, 500]
    assert (got[1]["x"], got[1]["y"], got[1]["width"], got[1]["height"]) == (14, 4, 33, 33)
    assert (png.decode(base64.b64decode(got[1]["color"]))[..., :3] == image[4:37, 14:47]).all()
    assert all(got[i]["detail"] and got[i]["color"] is None for i in range(2, 8)) and got[5]["detail"] == "missing: prompt"


def test_surface(spark):
    settings = Settings.of(spark)
    assert (settings.http_url, settings.ws_url, settings.max_cache_bytes, settings.source_dir) == ("http://127.0.0.1:5545", "ws://127.0.0.1:5545/ws", 2048 * 1024 * 1024, "./cache/sources")
    spark.conf.set("rasterloom.max_cache_files", "7")
    assert Settings.of(spark).max_cache_files == 7
    spark.conf.unset("rasterloom.max_cache_files")

    def down(url):
        raise OSError(url)

    assert tuple(requests.health(spark, settings, down).first()) == ("error", "http://127.0.0.1:5545", False)
    assert requests.health(spark, settings, lambda url: 500).first()["connected"]
    up = requests.uploads(spark.createDataFrame([("a", "x.jpg", bytearray(b"1")), ("b", "noext", bytearray(b"2"))], "source_id string, filename string, content binary"), "d")
    assert [(r["status"], r["path"]) for r in up.orderBy("source_id").collect()] == [("cached", "d/a.jpg"), ("cached", "d/b.png")]
    log = spark.createDataFrame([("INFO", "uvicorn.access", ["h", "GET", "/health"]), ("INFO", "uvicorn.access", ["h", "GET", "/health/x"]), ("INFO", "e", ["h"]), ("DEBUG", "e", None)], "level string, logger string, args array<string>")
    assert [r["args"][2] for r in requests.access_lines(log).collect()] == ["/health/x"]
    assert sorted(r["label"] for r in requests.labelled(log, {"uvicorn.access": "access"}).collect()) == ["access", "access", "app"]


def test_time_limit(spark, tmp_path):
    """A run without an end is reported once both watermarks have passed its limit."""
    start = [("p", 0), ("q", 0)], [("later", 6000)], [("last", 12000)]
    ends = [("p", 60)], [("x", 6000)], [("y", 12000)]
    for name, parts in (("a", start), ("b", ends)):
        for part in parts:
            df = spark.createDataFrame(part, "prompt_id string, s int").select("prompt_id", F.timestamp_seconds(F.col("s") + 100_000).alias("ts"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.05)
    read = lambda n: spark.readStream.schema("prompt_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    q = runs_with_timeout(read("a"), read("b"), "5 minutes").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {r["prompt_id"]: r["done_at"] for r in spark.table("limited").collect()}
    assert got["p"] is not None and got["q"] is None


def test_remote_backend(spark):
    """Runs, refusals, runs without images or end, and a backend that is down, by a transport that plays them."""

    def send(method, url, body):
        if method == "POST":
            prompt = json.loads(body)
            assert len(prompt["client_id"]) == 36
            case = prompt["prompt"]["case"]
            if case == "down":
                raise OSError("refused")
            return (400, b"bad") if case == "refused" else (200, json.dumps({"prompt_id": case}).encode())
        case = url.rpartition("/")[2]
        if "/history/" in url:
            images = {"good": [{"filename": "a b", "subfolder": "", "type": "output"}], "empty": []}.get(case)
            return 200, json.dumps({} if case == "slow" else {case: {"outputs": {"1": {}} | ({"2": {"images": images}} if images is not None else {})}}).encode()
        assert url.endswith("/view?filename=a+b&subfolder=&type=output")
        return 200, b"image"

    cases = ["good", "refused", "down", "empty", "none", "slow"]
    ready = spark.createDataFrame([(c, json.dumps({"case": c, "text": "__client__"})) for c in cases], "request_id string, workflow string")
    got = {r["request_id"]: r for r in remote_backend(Settings.of(spark), send, tries=2, pause=0.01)(ready).collect()}
    assert bytes(got["good"]["result"]) == b"image" and got["good"]["failed"] is None
    assert [got[c]["failed"] for c in cases[1:]] == ["backend refused the run: bad", "connection: refused", "empty list of images", "no output images", "run slow hasn't ended"]
    row = spark.sql("SELECT 'a b' AS f, '' AS s, 'output' AS t").select(view_url("http://h:1", F.col("f"), F.col("s"), F.col("t"))).first()
    assert row[0] == "http://h:1/view?filename=a+b&subfolder=&type=output"
