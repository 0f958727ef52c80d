"""Requests from validation to response, and their logs, as DataFrames.

The image model behind the backend is outside; `inpaint` takes it as a function of DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.config import Settings
from rasterloom.functions.text import default_seed, extension, unpack_base64
from rasterloom.operators.patches import alpha_masks, patches
from rasterloom.operators.workflow import bind
from rasterloom.schemas import NEGATIVE_PROMPT
from rasterloom.scratch import written

REQUIRED = ("source_id", "prompt", "mask_image_base64")


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with defaults and invalid: which required fields are missing, or null."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in REQUIRED]))
    return requests.withColumns({
        "negative_prompt": F.coalesce("negative_prompt", F.lit(NEGATIVE_PROMPT)),
        "seed": F.coalesce("seed", F.lit(0).cast("long")),
        "invalid": F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
    })


#: Fields of a request's body, their types, and what stands for those that may be left out.
FIELDS = {"source_id": ("string", None), "prompt": ("string", None), "negative_prompt": ("string", NEGATIVE_PROMPT), "mask_image_base64": ("string", None), "seed": ("int", 0)}


def _problem(name: str, body: Column) -> Column:
    """What is wrong with a field of a body (variant); null if nothing is. An explicit null isn't a missing field."""
    kind, default = FIELDS[name]
    value = F.try_variant_get(body, f"$.{name}", "variant")
    found, text = F.schema_of_variant(value), F.try_variant_get(body, f"$.{name}", "string")
    if kind == "string":
        wrong = F.when(found != "STRING", "string_type")
    else:
        number = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        whole = F.coalesce(F.rint(text.try_cast("double")) == text.try_cast("double"), F.lit(False))
        wrong = (
            F.when(number & ~whole, "int_from_float").when(number | (found == "BOOLEAN"), None).when((found == "STRING") & ~text.rlike(r"^\s*[+-]?\d+\s*$"), "int_parsing")
            .when(found != "STRING", "int_type")
        )
        wrong = F.when(wrong.isNull() & found.isNotNull() & _whole_number(body, name).isNull(), "int_range").otherwise(wrong)
    return F.when(value.isNull() & found.isNull(), F.lit("missing") if default is None else F.lit(None).cast("string")).otherwise(wrong)


def _whole_number(body: Column, name: str) -> Column:
    text = F.trim(F.try_variant_get(body, f"$.{name}", "string"))
    return F.when(text == "true", 1).when(text == "false", 0).otherwise(F.coalesce(text.try_cast("bigint"), text.try_cast("decimal(38,9)").try_cast("bigint"), text.try_cast("double").try_cast("bigint"))).cast("bigint")


def validated(bodies: DataFrame, key: str = "request_id", text: str = "body") -> tuple[DataFrame, DataFrame]:
    """Raw JSON bodies (key, text, and others) as requests (the other columns, and schemas.INPAINT_REQUEST), and the
    rejected fields (key, field, problem).

    Bodies with a rejected field are no requests. Absent fields have their default, or are missing; a null or a value
    of another type is a problem of its field. Whole numbers may come as text, as 3.0 or as booleans; those beyond 64
    bits are rejected. What isn't JSON, or no object, has a problem without a field. Of unknown fields nothing is
    said."""
    parsed = bodies.withColumn("__body", F.try_parse_json(text))
    kind = F.schema_of_variant("__body")
    whole = F.when(F.col("__body").isNull(), "json_invalid").when(~kind.startswith("OBJECT"), "model_type")
    each = F.array_compact(F.array(*[F.when((p := _problem(n, F.col("__body"))).isNotNull(), F.struct(F.lit(n).alias("field"), p.alias("problem"))) for n in FIELDS]))
    problems = F.when(whole.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("field"), whole.alias("problem")))).otherwise(each)
    judged = parsed.withColumn("__problems", problems)
    value = lambda n: _whole_number(F.col("__body"), n) if FIELDS[n][0] == "int" else F.try_variant_get("__body", f"$.{n}", "string")
    fields = [F.coalesce(value(n), F.lit(default).cast("bigint" if k == "int" else "string")).alias(n) for n, (k, default) in FIELDS.items()]
    accepted = judged.where(F.size("__problems") == 0).select(*[c for c in bodies.columns if c != text], *fields)
    return accepted, judged.select(key, F.explode("__problems").alias("p")).select(key, "p.field", "p.problem")


def uploads(requests: DataFrame, directory: str) -> DataFrame:
    """(source_id, status, path, content) of uploads: where each source is kept."""
    path = F.concat(F.lit(directory + "/"), "source_id", extension(F.col("filename")))
    return requests.select("source_id", F.lit("cached").alias("status"), path.alias("path"), "content")


def health(spark: SparkSession, settings: Settings, probe: Callable[[str], object]) -> DataFrame:
    """One row: status, url, connected. Any answer of the backend counts; any exception is an error."""
    try:
        probe(settings.http_url)
        up = True
    except Exception:  # noqa: BLE001  whatever keeps the backend from answering
        up = False
    return spark.range(1).select(F.lit("ok" if up else "error").alias("status"), F.lit(settings.http_url).alias("url"), F.lit(up).alias("connected"))


def status_code(kind: Column) -> Column:
    """HTTP status of an error's kind; 200 for none."""
    return F.when(kind.isNull(), 200).when(kind == "invalid", 422).when(kind == "not_found", 404).when(kind == "connection", 502).otherwise(500)


def inpaint(requests: DataFrame, sources: DataFrame, template: str, backend: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row for each request (schemas.INPAINT_REQUEST with request_id and ts): status_code, detail, and the patch.

    sources: (source_id, path). backend: from rows (request_id, workflow, source_id, mask) to (request_id, result,
    failed): an image, or why there is none; `connection: ...` stands for an unreachable backend. The patch is cut by
    the mask as it was sent; the backend gets it as the alpha of a black image."""
    checked = with_defaults(requests)
    found = checked.join(sources.select("source_id", F.col("path").alias("source_path")), "source_id", "left")
    raw = unpack_base64(F.col("mask_image_base64"))
    prepared = found.withColumns({"mask": raw, "mask_path": F.concat(F.lit("mask_"), F.col("request_id").cast("string"), F.lit(".png")), "seed": default_seed(F.col("seed"), F.col("ts"))})
    prepared = prepared.withColumn("sent", alpha_masks(F.col("mask")))
    bound = bind(prepared, template)
    kind = (
        F.when(F.col("invalid").isNotNull(), "invalid").when(F.col("source_path").isNull(), "not_found").when(F.col("mask").isNull(), "base64")
        .when(F.col("sent.error").isNotNull(), "mask").when(F.col("error").isNotNull(), "workflow")
    )
    detail = F.coalesce("invalid", F.when(F.col("source_path").isNull(), "source is not cached"), F.when(F.col("mask").isNull(), "incorrect padding"), "sent.error", "error")
    # both are written: each mask is drawn once, and a lost executor submits no run again
    judged = written(bound.select("request_id", "source_id", "mask", "workflow", F.when(kind.isNull(), F.col("sent.content")).alias("sent"), kind.alias("kind"), F.when(kind.isNotNull(), detail).alias("detail")))
    ready = judged.where("kind is null").select("request_id", "workflow", "source_id", F.col("sent").alias("mask"))
    answers = written(backend(ready))
    answered = judged.select("request_id", "mask", "kind", "detail").join(answers, "request_id", "left")
    refused = F.when(F.col("failed").startswith("connection"), "connection").when(F.col("failed").isNotNull(), "backend")
    answered = answered.withColumns({"kind": F.coalesce("kind", refused), "detail": F.coalesce("detail", "failed")})
    cut = answered.withColumn("patch", F.when(F.col("kind").isNull(), patches(F.col("result"), F.col("mask"))))
    kind = F.coalesce("kind", F.when(F.col("patch.error").isNotNull(), "image"))
    fields = ["x", "y", "width", "height", "color", "mask"]
    return cut.select("request_id", status_code(kind).alias("status_code"), F.coalesce("detail", "patch.error").alias("detail"), *[F.col(f"patch.{c}").alias(c) for c in fields])


def echo_backend(sources: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A stand-in that returns the source image: sources (source_id, content)."""
    kept = sources.select("source_id", F.col("content").alias("result"))
    return lambda ready: ready.join(kept, "source_id", "left").select("request_id", "result", F.when(F.col("result").isNull(), "no such source").alias("failed"))


def last_sent(requests: DataFrame) -> DataFrame:
    """The latest input of each suffix (columns path, payload, ts), under the fixed name that it is kept as."""
    name = F.concat(F.lit("last_sent_image"), extension(F.col("path"), ""))
    return requests.groupBy(name.alias("name")).agg(F.max_by("payload", "ts").alias("payload"), F.max("ts").alias("ts"))


def access_lines(log: DataFrame, args: str = "args") -> DataFrame:
    """Log records with three arguments or more, whose third isn't the health check."""
    return log.where((F.size(args) >= 3) & (F.get(args, 2) != "/health"))


def labelled(log: DataFrame, loggers: dict[str, str], default: str = "app") -> DataFrame:
    """Log records at INFO or above with the label of their logger."""
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in loggers.items() for x in kv])[F.col("logger")], F.lit(default)) if loggers else F.lit(default)
    return log.where(F.col("level").isin("INFO", "WARNING", "ERROR", "CRITICAL")).withColumn("label", label)


def stage_times(events: DataFrame) -> DataFrame:
    """(request_id, stage, seconds) from rows (request_id, stage, ts), the first and last of each stage."""
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return events.groupBy("request_id", "stage").agg((seconds / 1e6).alias("seconds"))
