"""Templates as a table, and raw bodies told apart by VARIANT."""

import json

import pytest

from rasterloom.operators import requests, workflow

DOCUMENT = {
    "1": {"inputs": {"name": "m.bin"}, "class_type": "Load", "_meta": {"title": "L", "a": 1}},
    "7": {"inputs": {"text": 'good "q"\n', "clip": ["1", 1]}, "class_type": "Text"},
    "8": {"class_type": "Text", "inputs": {"text": "", "z": None, "clip": ["1", 1]}},
    "30": {"inputs": {"image": "x"}, "class_type": "Image"},
    "47": {"inputs": {}, "class_type": "Image", "é\"k": "{no object"},
    "28": {"inputs": {"seed": 1, "cfg": 1.50, "ok": True, "digits": "12", "list": "[1]", "a": ["7", 0], "o": {"z": 1, "a": "b"}}, "class_type": "Run", "n": 1},
}


def bound(seed, prompt, negative, source, mask):
    want = json.loads(json.dumps(DOCUMENT))
    want["28"]["inputs"]["seed"], want["7"]["inputs"]["text"], want["8"]["inputs"]["text"] = seed, prompt, negative
    want["30"]["inputs"]["image"], want["47"]["inputs"]["image"] = source, mask
    return want


def test_templates(spark):
    lacks = {k: v for k, v in DOCUMENT.items() if k != "47"} | {"8": {"inputs": {}, "class_type": "Text"}}
    texts = [("a", json.dumps(DOCUMENT, indent=2)), ("b", json.dumps(lacks)), ("c", "{broken"), ("d", "[1]"), ("e", None), ("f", "{}")]
    templates = spark.createDataFrame(texts, "template_id string, text string")
    asked = [(1, "a", "d\\s.png", "m\\k.png", 'a "b"', "bad\n", 5), (2, "a", "s", "m", "", None, 2**60), (3, "b", "s", "m", "p", "n", 1), (4, "c", "s", "m", "p", "n", 1), (5, "d", "s", "m", "p", "n", 1), (6, "e", "s", "m", "p", "n", 1), (7, "none", "s", "m", "p", "n", 1), (8, None, "s", "m", "p", "n", 1)]
    rows = spark.createDataFrame(asked, "i int, template_id string, source_path string, mask_path string, prompt string, negative_prompt string, seed long")
    found = {r["i"]: r for r in workflow.bind_templates(rows, templates).collect()}
    one, two = json.loads(found[1]["workflow"]), json.loads(found[2]["workflow"])
    assert one == bound(5, 'a "b", good "q"\n', "bad\n", "d/s.png", "m/k.png") and two == bound(2**60, 'good "q"\n', "", "s", "m")
    # order and numbers stay as they are written
    assert found[1]["workflow"] == json.dumps(one, separators=(",", ":"), ensure_ascii=False) and list(one) == list(DOCUMENT) and list(one["28"]["inputs"]) == list(DOCUMENT["28"]["inputs"])
    assert [found[i]["error"] for i in range(1, 9)] == [None, None, "template lacks node 47, node 8 input text", *["template is no document"] * 3, "no such template", "no such template"]
    assert all(found[i]["workflow"] is None for i in range(3, 9))
    missing = {tuple(r) for r in workflow.missing_in_templates(templates).collect()}
    assert missing == {("b", "47", None), ("b", "8", "text"), *(("f", n, None) for n in ("28", "7", "8", "30", "47"))}


def test_changes_are_worked_out_once(spark):
    """However many nodes and inputs ask for them, what is bound into a document stands in the expression once."""
    rows = spark.createDataFrame([(json.dumps(DOCUMENT), {"7": {"text": "1"}}), (None, {"7": {"text": "1"}})], "t string, marked map<string, map<string, string>>")
    found = rows.select(workflow.rewritten(rows["t"], rows["marked"]).alias("w"))
    assert found._jdf.queryExecution().analyzed().expressions().toString().count("marked#") == 1
    one, none = (r["w"] for r in found.collect())
    assert none is None and json.loads(one)["7"]["inputs"] == {"text": 1, "clip": ["1", 1]} and json.loads(one)["28"] == DOCUMENT["28"]


GOOD = {"source_id": "s", "prompt": "p", "mask_image_base64": "m"}


@pytest.mark.parametrize(
    ("body", "problems", "seed"),
    [
        (GOOD, [], 0), (GOOD | {"seed": 7}, [], 7), (GOOD | {"seed": "12"}, [], 12), (GOOD | {"seed": 3.0}, [], 3), (GOOD | {"seed": True}, [], 1), (GOOD | {"other": [1]}, [], 0), (GOOD | {"seed": 2**62}, [], 2**62),
        (GOOD | {"seed": None}, [("seed", "int_type")], None), (GOOD | {"seed": 1.5}, [("seed", "int_from_float")], None), (GOOD | {"seed": "x"}, [("seed", "int_parsing")], None), (GOOD | {"seed": [1]}, [("seed", "int_type")], None),
        (GOOD | {"seed": 2**70}, [("seed", "int_range")], None), (GOOD | {"prompt": None}, [("prompt", "string_type")], None), (GOOD | {"prompt": 5, "source_id": {}}, [("prompt", "string_type"), ("source_id", "string_type")], None),
        (GOOD | {"negative_prompt": None}, [("negative_prompt", "string_type")], None), ({"prompt": ""}, [("mask_image_base64", "missing"), ("source_id", "missing")], None), ({}, [("mask_image_base64", "missing"), ("prompt", "missing"), ("source_id", "missing")], None),
        ([1], [(None, "model_type")], None), ("text", [(None, "model_type")], None), (None, [(None, "model_type")], None),
    ],
)
def test_bodies(spark, body, problems, seed):
    rows = spark.createDataFrame([(1, json.dumps(body), "kept")], "request_id int, body string, more string")
    accepted, rejected = requests.validated(rows)
    assert sorted(((r["field"], r["problem"]) for r in rejected.collect()), key=str) == sorted(problems, key=str)
    found = accepted.collect()
    assert [(r["more"], r["seed"], r["prompt"], r["negative_prompt"]) for r in found] == ([] if problems else [("kept", seed, "p", requests.NEGATIVE_PROMPT)])


def test_bodies_that_are_not_json(spark):
    accepted, rejected = requests.validated(spark.createDataFrame([(1, "{no"), (2, ""), (3, None)], "request_id int, body string"))
    assert accepted.count() == 0 and {tuple(r) for r in rejected.collect()} == {(i, None, "json_invalid") for i in (1, 2, 3)}
