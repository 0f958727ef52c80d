"""Progress messages and run histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.schemas import IMAGE_REF, PROGRESS


def parse_messages(frames: DataFrame, text: str = "value") -> DataFrame:
    """Text frames as (frames' columns, type, node, prompt_id); frames without text are left out, and what isn't JSON
    has nulls."""
    message = F.from_json(text, PROGRESS)
    return frames.where(F.col(text).isNotNull()).select("*", message["type"].alias("type"), message["data"]["node"].alias("node"), message["data"]["prompt_id"].alias("prompt_id"))


def is_end() -> Column:
    """A run ends with a message that nothing of it is executing any more."""
    return (F.col("type") == "executing") & F.col("node").isNull() & F.col("prompt_id").isNotNull()


def completion(submitted: DataFrame, messages: DataFrame) -> DataFrame:
    """submitted (prompt_id, ts) with done_at: the first end message at or after it; null while a run goes on.

    Submissions and the distinct times of ends stand in one order, so each is read once however many a run has."""
    ends = messages.where(is_end()).select("prompt_id", "ts", F.col("ts").alias("end")).distinct()
    both = submitted.select("prompt_id", "ts").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)).union(ends)
    # from the last row to the first: a row sees all ends at or after it
    later = Window.partitionBy("prompt_id").orderBy(F.desc("ts"), F.col("end").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("done_at", F.min("end").over(later)).where("end is null").select("prompt_id", "ts", "done_at")


def first_images(histories: DataFrame, prompt_id: str = "prompt_id", history: str = "history") -> DataFrame:
    """(prompt_id, filename, subfolder, type, error) of the first node, in the document's order, that has images.

    A history without the run, a run without images, and a node with an empty list of them are errors. Each document
    is parsed once."""
    parsed = F.from_json(history, f"map<string, struct<outputs: map<string, struct<images: array<{IMAGE_REF}>>>>>")
    runs = histories.select(prompt_id, parsed.alias("parsed")).select(prompt_id, F.col("parsed")[F.col(prompt_id)].alias("run"))
    having = F.filter(F.map_values("run.outputs"), lambda e: e["images"].isNotNull())
    first = runs.select(prompt_id, F.col("run").isNotNull().alias("known"), F.get(having, 0)["images"].alias("images"))
    error = F.when(~F.col("known"), "history has no such run").when(F.col("images").isNull(), "no output images").when(F.size("images") < 1, "empty list of images")
    return first.select(prompt_id, F.get("images", 0).alias("i"), error.alias("error")).select(prompt_id, "i.filename", "i.subfolder", "i.type", "error")
