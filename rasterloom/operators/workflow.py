"""Workflow documents as relations: nodes, literal inputs and edges; binding, validation and traversal."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.text import merge_prompt, normal_path
from rasterloom.schemas import WORKFLOW
from rasterloom.scratch import forget, written

#: Where a template binds a request: (node, input, what). Fixed values of the served template's layout.
BINDINGS = (("28", "seed", "seed"), ("7", "text", "prompt"), ("8", "text", "negative_prompt"), ("30", "image", "source_path"), ("47", "image", "mask_path"))
#: Edges of ways that a closure takes one at a time before it doubles them.
STEPS = 32
#: From so many pairs on, more joins of edges cost less than pairs that are made several times.
MANY = 1_000_000


def read_workflow(spark: SparkSession, path: str) -> DataFrame:
    """One row: text. A missing file raises when it is read."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def nodes(workflows: DataFrame, text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, node_id, class_type, title, inputs) in the document's order; invalid JSON raises."""
    parsed = F.from_json(text, WORKFLOW, {"mode": "FAILFAST"})
    rows = workflows.select(*keys, F.posexplode(parsed).alias("pos", "node_id", "node"))
    return rows.select(*keys, "pos", "node_id", "node.class_type", F.col("node._meta.title").alias("title"), "node.inputs")


def inputs(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node_id, name, value): every input, as JSON."""
    return found.select(*keys, "node_id", F.explode("inputs").alias("name", "value"))


def is_edge(value: Column) -> Column:
    return F.coalesce(value.rlike(r'^\s*\[\s*"[^"]*"\s*,\s*\d+\s*\]\s*$'), F.lit(False))


def literals(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return inputs(found, keys).where(~is_edge(F.col("value")))


def edges(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, slot, dst, input_name) of the inputs that are references."""
    rows = inputs(found, keys).where(is_edge(F.col("value")))
    return rows.select(*keys, F.get_json_object("value", "$[0]").alias("src"), F.get_json_object("value", "$[1]").cast("int").alias("slot"), F.col("node_id").alias("dst"), F.col("name").alias("input_name"))


def missing_bindings(found: DataFrame) -> DataFrame:
    """(node_id, name) of what a request needs and the template lacks: the nodes with inputs, and the texts that are
    read before they are replaced. Other inputs are made where they are missing."""
    spark = found.sparkSession
    values = ", ".join(f"('{n}', {f"'{i}'" if i == 'text' else 'null'})" for n, i, _ in BINDINGS)
    need = spark.sql(f"SELECT * FROM VALUES {values} AS t(node_id, name)")
    has = found.where("inputs is not null").select("node_id", F.map_keys("inputs").alias("names"))
    joined = need.join(has, "node_id", "left")
    return joined.where(F.col("names").isNull() | (F.col("name").isNotNull() & ~F.coalesce(F.array_contains("names", F.col("name")), F.lit(False)))).select("node_id", "name")


def bind(requests: DataFrame, template: str) -> DataFrame:
    """requests (source_path, mask_path, prompt, negative_prompt, seed, and others) with workflow, the bound document's
    JSON, and error: which binding the template lacks. The template is one document, a literal of the plan."""
    spark = requests.sparkSession
    found = nodes(spark.range(1).select(F.lit(template).alias("text")))
    lacks = [f"node {r['node_id']}" + (f" input {r['name']}" if r["name"] else "") for r in missing_bindings(found).orderBy("node_id", "name").collect()]
    if lacks:
        return requests.select("*", F.lit(None).cast("string").alias("workflow"), F.lit("template lacks " + ", ".join(lacks)).alias("error"))
    document, marks = json.loads(template), {}
    text = {n: document[n]["inputs"]["text"] for n in ("7", "8")}
    for node, name, what in BINDINGS:
        marks[what] = document[node]["inputs"][name] = uuid.uuid4().hex
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    bound = {
        "seed": F.col("seed").cast("string"),
        "prompt": quoted(merge_prompt(F.col("prompt"), F.lit(text["7"]))),
        "negative_prompt": quoted(merge_prompt(F.col("negative_prompt"), F.lit(text["8"]))),
        "source_path": quoted(normal_path(F.col("source_path"))),
        "mask_path": quoted(normal_path(F.col("mask_path"))),
    }
    # the document's text with a value at each mark: a projection of literals and five columns
    parts = re.split("|".join(f'("{m}")' for m in marks.values()), json.dumps(document, ensure_ascii=False))
    at = {f'"{m}"': what for what, m in marks.items()}
    pieces = [bound[at[p]] if p in at else F.lit(p) for p in parts if p]
    return requests.select("*", F.concat(*pieces).alias("workflow"), F.lit(None).cast("string").alias("error"))


def _named(found_edges: DataFrame) -> DataFrame:
    return found_edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Written, and the number of its rows, which the same job counts."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def _twice(step: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs that a way of the one and a way of the other connect."""
    return step.join(other.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct()


def _powers(pairs: DataFrame, nodes: int) -> tuple[list[DataFrame], bool]:
    """Pairs (src, dst) with a way of exactly 1, 2, 4, ... edges, as long as there are any; and whether there is one of
    as many edges as there are nodes, so that one goes round in a circle."""
    step, n = _counted(pairs)
    powers, length = [], 1
    while n:
        powers.append(step)
        if length >= nodes:
            return powers, True
        step, n = _counted(_twice(step, step))
        length *= 2
    forget(step)
    return powers, False


def depths(found_edges: DataFrame, found_nodes: DataFrame) -> DataFrame:
    """(node_id, depth): the longest path from a root; a graph with a cycle raises. For nodes and edges (src, dst).

    Ways of 1, 2, 4, ... edges are worked out from each other; then, from the longest down, every node goes back by
    them as far as it can. So the rounds are twice the depth's binary digits, however deep the graph is."""
    nodes = written(found_nodes.select("node_id").distinct())
    powers, circle = _powers(_named(found_edges), max(1, nodes.count()))
    if circle:
        forget(nodes, *powers)
        raise ValueError("the graph has a cycle")
    # at: where ways of the node's length so far begin
    front = nodes.select("node_id", F.col("node_id").alias("at"), F.lit(0).alias("depth"))
    made = [nodes]
    for k in range(len(powers) - 1, -1, -1):
        back = front.join(powers[k].select(F.col("dst").alias("at"), "src"), "at").select("node_id", F.col("src").alias("at"), (F.col("depth") + (1 << k)).alias("depth"))
        both = front.union(back).groupBy("node_id", "at").agg(F.max("depth").alias("depth"))
        longest = F.max("depth").over(Window.partitionBy("node_id"))
        front = written(both.withColumn("most", longest).where("depth = most").drop("most"))
        made.append(front)
    out = front.groupBy("node_id").agg(F.max("depth").alias("depth"))
    if not powers:
        return out
    out = written(out)
    forget(*powers, *made)
    return out


def reach(found_edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(src, dst) of all nodes that a path of one edge or more leads between.

    Ways of 1, 2, 3, ... edges are taken one edge at a time, so that a pair is made once for each edge its ways begin
    with, and are brought together at the end. If there still are ways after `steps` edges, or after 4 where pairs are
    few, pairs of up to n edges and ways of n edges double from there, so that the rounds stay few however long the ways
    are."""
    edges, n = _counted(_named(found_edges))
    ways, length, made = [edges], 1, n
    while n and length < steps and (length < 4 or made >= MANY):
        step, n = _counted(_twice(edges, ways[-1]))
        ways.append(step)
        length, made = length + 1, made + n
    pairs = reduce(DataFrame.union, ways).distinct()
    if not n:
        return pairs
    pairs, m = _counted(pairs)
    step = ways.pop()
    forget(*ways)
    while n:
        more, total = _counted(pairs.union(_twice(pairs, step)).distinct())
        forget(pairs)
        pairs = more
        if total == m:
            break
        m = total
        longer, n = _counted(_twice(step, step))
        forget(step)
        step = longer
    forget(step)
    return pairs


def _trimmed(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Edges without those from where none leads to or to where none leads from, and their number: again and again,
    as long as a round takes a twentieth of them, so that all rounds together cost about as much as a few."""
    pairs, n = _counted(pairs)
    while n:
        froms, tos = pairs.select(F.col("src").alias("node")).distinct(), pairs.select(F.col("dst").alias("node")).distinct()
        kept, m = _counted(pairs.join(tos.withColumnRenamed("node", "src"), "src", "left_semi").join(froms.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        forget(pairs)
        pairs, before, n = kept, n, m
        if 20 * n > 19 * before:
            break
    return pairs, n


def cycles(found_edges: DataFrame) -> DataFrame:
    """(node_id) of the nodes that are on a cycle. First all that no long way leads to or from are trimmed, edge by edge
    while that takes many, then by ways of 1, 2, 4, ... edges; what stays lies on cycles or between them, and of that
    the closure tells who reaches itself."""
    pairs, n = _trimmed(_named(found_edges))
    nodes = n and pairs.select(F.col("src").alias("node_id")).union(pairs.select("dst")).distinct().count()
    powers, circle = _powers(pairs, max(1, nodes))
    if not circle:
        forget(*powers)
        return pairs.select(F.col("src").alias("node_id")).limit(0)
    core = powers[-1].select(F.col("src").alias("node_id")).intersect(powers[-1].select(F.col("dst").alias("node_id")))
    inside = pairs.join(core.withColumnRenamed("node_id", "src"), "src", "left_semi").join(core.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    # of cycles no way is the longest, so single edges would only delay the doubling
    out = written(reach(inside, 1).where("src = dst").select(F.col("src").alias("node_id")))
    forget(pairs, *powers)
    return out


def sinks(found_edges: DataFrame, found_nodes: DataFrame) -> DataFrame:
    return found_nodes.select("node_id").join(found_edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")


def dangling(found_edges: DataFrame, found_nodes: DataFrame) -> DataFrame:
    """Edges whose producer isn't in the document."""
    return found_edges.join(found_nodes.select(F.col("node_id").alias("src")), "src", "left_anti")


def _is_text(value: Column) -> Column:
    """Whether a variant is a string."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _member(key: Column, raw: Column, typed: Column) -> Column:
    """One member of an object: raw is the value's JSON, but for strings, which the variant tells, their content."""
    value = F.when(_is_text(typed), quoted(raw)).otherwise(F.coalesce(raw, F.lit("null")))
    return F.concat(quoted(key), F.lit(":"), value)


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is worked out once however often body names it, in functions of arrays too."""
    return F.get(F.transform(F.array(value), body), 0)


def _parsed(text: Column, kind: str) -> Column:
    """A JSON object twice: members as their JSON, but strings as their content; and as variants, which tell these."""
    return F.struct(F.from_json(text, kind.format("string")).alias("raw"), F.from_json(text, kind.format("variant")).alias("typed"))


def rewritten(text: Column, changes: Column) -> Column:
    """A workflow document's JSON with other inputs. changes: map of nodes to maps of inputs to JSON values. Everything
    else, its order included, stays; inputs that a node lacks come last, nodes that the document lacks are passed
    over. Null for what isn't a document: an object of objects."""

    def inputs_of(old: Column, new: Column) -> Column:
        kept = F.transform(F.map_entries(old["raw"]), lambda e: F.coalesce(F.concat(quoted(e["key"]), F.lit(":"), F.try_element_at(new, e["key"])), _member(e["key"], e["value"], old["typed"][e["key"]])))
        more = F.filter(F.map_entries(new), lambda e: ~F.array_contains(F.map_keys(old["raw"]), e["key"]))
        return _object(F.concat(kept, F.transform(more, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))))

    def fields_of(fields: Column, typed: Column, new: Column) -> Column:
        def one(f: Column) -> Column:
            changed = F.concat(F.lit('"inputs":'), _with(_parsed(f["value"], "map<string, {}>"), lambda old: inputs_of(old, new)))
            return F.when((f["key"] == "inputs") & f["value"].startswith("{") & new.isNotNull(), changed).otherwise(_member(f["key"], f["value"], typed[f["key"]]))

        return _object(F.transform(F.map_entries(fields), one))

    def document(at: Column) -> Column:
        found, new = at["found"], at["changes"]
        one = lambda n: _with(F.struct(n.alias("n"), F.try_element_at(new, n["key"]).alias("new")), lambda x: F.concat(quoted(x["n"]["key"]), F.lit(":"), fields_of(x["n"]["value"], found["typed"][x["n"]["key"]], x["new"])))
        return F.when(found["raw"].isNotNull(), _object(F.transform(F.map_entries(found["raw"]), one)))

    # the changes too are worked out once: they may be made of the document, and every node and input asks for them
    return _with(F.struct(_parsed(text, "map<string, map<string, {}>>").alias("found"), changes.alias("changes")), document)


def lacking(text: Column, bindings: tuple = BINDINGS) -> Column:
    """Array of (node_id, name): what a request needs and the document lacks. Of nodes without inputs name is null;
    texts that are read before they are replaced must be there. Null for what isn't a document."""

    def tests(found: Column) -> Column:
        out = []
        for node, name, what in bindings:
            inputs_ = F.try_element_at(F.try_element_at(found, F.lit(node)), F.lit("inputs"))
            names = F.json_object_keys(inputs_)
            gone = F.struct(F.lit(node).alias("node_id"), F.lit(None).cast("string").alias("name"))
            needs = what in ("prompt", "negative_prompt")
            out.append(F.when(names.isNull(), gone).when(F.lit(needs) & ~F.array_contains(names, name), F.struct(F.lit(node).alias("node_id"), F.lit(name).alias("name"))))
        return F.when(found.isNotNull(), F.array_distinct(F.array_compact(F.array(*out))))

    return _with(F.from_json(text, "map<string, map<string, string>>"), tests)


def missing_in_templates(templates: DataFrame, key: str = "template_id", text: str = "text", bindings: tuple = BINDINGS) -> DataFrame:
    """(key, node_id, name) of everything that templates lack."""
    return templates.select(key, F.explode(lacking(F.col(text), bindings)).alias("m")).select(key, "m.node_id", "m.name")


def bind_templates(requests: DataFrame, templates: DataFrame, key: str = "template_id", text: str = "text", bindings: tuple = BINDINGS) -> DataFrame:
    """requests (key, source_path, mask_path, prompt, negative_prompt, seed, and others) with workflow, the document of
    the request's own template with the request bound into it, and error: no such template, no document, or what it
    lacks. templates: a row for each key."""
    judged = templates.select(key, F.col(text).alias("__text"), lacking(F.col(text), bindings).alias("__lacks"))
    rows = requests.join(judged.withColumn("__known", F.lit(True)), key, "left")
    where = {what: (node, name) for node, name, what in bindings}
    own = lambda what: F.get_json_object("__text", f"$['{where[what][0]}'].inputs['{where[what][1]}']")
    values = {
        "seed": F.col("seed").cast("string"), "prompt": quoted(merge_prompt(F.col("prompt"), own("prompt"))), "negative_prompt": quoted(merge_prompt(F.col("negative_prompt"), own("negative_prompt"))),
        "source_path": quoted(normal_path(F.col("source_path"))), "mask_path": quoted(normal_path(F.col("mask_path"))),
    }
    by_node: dict[str, list[Column]] = {}
    for node, name, what in bindings:
        by_node.setdefault(node, []).extend([F.lit(name), values[what]])
    changes = F.create_map(*[x for node, pairs in by_node.items() for x in (F.lit(node), F.create_map(*pairs))])
    one = lambda m: F.concat(F.lit("node "), m["node_id"], F.coalesce(F.concat(F.lit(" input "), m["name"]), F.lit("")))
    error = (
        F.when(F.col("__known").isNull(), "no such template").when(F.col("__lacks").isNull(), "template is no document")
        .when(F.size("__lacks") > 0, F.concat(F.lit("template lacks "), F.array_join(F.array_sort(F.transform("__lacks", one)), ", ")))
    )
    return rows.withColumn("error", error).withColumn("workflow", F.when(F.col("error").isNull(), rewritten(F.col("__text"), changes))).select(*[c for c in requests.columns], "workflow", "error")
