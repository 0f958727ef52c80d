"""Column expressions for prompts, paths, seeds and packed payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_prompt(given: Column, template: Column) -> Column:
    """The two joined by a comma, without a separator where one is null or empty."""
    return F.concat_ws(", ", F.nullif(given, F.lit("")), F.nullif(template, F.lit("")))


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(filename: Column, default: str = ".png") -> Column:
    """The last dot of the last path part and what follows it, unless only dots come before; else the default."""
    found = F.regexp_extract(filename, r"[^/.][^/]*?(\.[^./]*)$", 1)
    found = F.when(found == "", F.regexp_extract(filename, r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)).otherwise(found)
    return F.when(F.coalesce(found, F.lit("")) == "", default).otherwise(found)


def stem(path: Column) -> Column:
    """The last path part without its extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^\.*[^.].*\.[^.]*$") & ~name.rlike(r"\.$"), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def default_seed(seed: Column, at: Column) -> Column:
    """The seed, or the request's time in epoch seconds where it is null or 0."""
    return F.coalesce(F.nullif(seed.cast("long"), F.lit(0).cast("long")), F.unix_seconds(at.cast("timestamp")))


def pack_base64(data: Column) -> Column:
    """Base64 in one line."""
    return F.translate(F.base64(data), "\r\n", "")


def is_base64(text: Column) -> Column:
    """Whether the alphabet's characters of the text end in proper padding; others are skipped, as when decoding."""
    kept = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    data = F.regexp_extract(kept, "^([A-Za-z0-9+/]*)(=*)", 1)
    return (F.length(data) % 4 != 1) & (F.length(F.regexp_extract(kept, "^([A-Za-z0-9+/]*)(=*)", 2)) >= F.pmod(-F.length(data), F.lit(4)))


def unpack_base64(text: Column) -> Column:
    """Decoded bytes; null where the padding is wrong."""
    kept = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    data = F.regexp_extract(kept, "^([A-Za-z0-9+/]*)", 1)
    padded = F.concat(data, F.repeat(F.lit("="), F.pmod(-F.length(data), F.lit(4)).cast("int")))
    return F.when(is_base64(text), F.unbase64(F.when(F.length(data) % 4 == 1, F.lit("")).otherwise(padded)))
