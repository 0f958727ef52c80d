"""URL filters by a Bloom filter cascade, in DataFrame operations alone.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with the rule's. So a
url's candidate keys are the ends of its host of as many labels as rules have, each with the starts of its path at the
lengths that rules have. For each verdict a cascade answers which candidates are listed: level 1 encodes the listed keys; level 2 those
keys of the corpus that level 1 lets through wrongly; level 3 the listed keys that level 2 lets through; and so on
until a level lets nothing through wrongly. As the levels were built over every candidate key of the corpus itself,
the depth at which a key first fails tells exactly whether it is listed. The first level has so many bits that it
lets through about as many keys as are listed, so every level stays as small as the list, times the logarithm of
the corpus at most, and stands in the expression as a literal: no join and no broadcast table. Lists too long for one
expression are told in shares, one pass each.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import forget, written

#: Listed keys of a verdict whose filters stand in one plan.
KEYS_A_PASS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def candidates(host: Column, path: Column, label_counts: set[int], path_lengths: set[int]) -> Column:
    """Array of the keys that rules for this url can have: hosts of as many labels, and paths as long, as rules have;
    longest host and path first."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    hosts = [F.when(n >= k, F.array_join(F.slice(labels, n - k + 1, F.lit(k)), ".")) for k in sorted(label_counts, reverse=True)]
    starts = [F.when(F.char_length(path) >= k, F.substring(path, 1, k)) for k in sorted(path_lengths, reverse=True)]
    keys = [F.concat(h, p) for h in hosts for p in starts]  # null where either is
    return F.when(host != "", F.array_compact(F.array(*keys))).otherwise(F.array().cast("array<string>")) if keys else F.array().cast("array<string>")


class Level(NamedTuple):
    """A Bloom filter: 32-bit words, how many bits they have, and the hashes of a key."""

    number: int
    words: list[int]
    bits: int
    hashes: int


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def passes(key: Column, level: Level) -> Column:
    """Whether all of the key's bits are set."""
    words = F.from_json(F.lit(str(level.words)), "array<bigint>")
    tests = [F.call_function("shiftright", F.get(words, F.shiftright(p, 5).cast("int")), (p % 32).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _positions(key, level.number, level.bits, level.hashes)]
    return reduce(lambda a, b: a & b, tests)


def _level(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A filter of n distinct keys at this rate of false positives; its words, of which the driver gets bits / 32 at most, are made by Spark."""
    hashes = min(16, max(1, round(-math.log2(rate))))
    bits = max(32, math.ceil(-hashes * n / math.log1p(-(rate ** (1 / hashes)))))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("set")).collect()
    words = [0] * -(-bits // 32)
    for r in rows:
        words[r["word"]] = r["set"]
    return Level(number, words, bits, hashes)


def first_level(listed: DataFrame, n_universe: int) -> Level | None:
    """Level 1 of a cascade that tells the listed keys (column `key`, distinct) from n_universe others; None for no keys."""
    n = listed.count()
    return _level(listed, n, 1, min(0.5, n / max(1, n_universe))) if n else None


def with_further_levels(listed: DataFrame, first: Level | None, through: DataFrame) -> list[Level]:
    """Level 1 and those that follow: through has all distinct keys of the universe that level 1 lets through."""
    if first is None:
        return []
    levels, tables = [first], [written(through.join(listed, "key", "left_anti"))]
    inside, outside = listed, tables[0]
    while n := outside.count():
        levels.append(_level(outside, n, len(levels) + 1, 0.25))
        tables.append(written(inside.where(passes(F.col("key"), levels[-1]))))
        inside, outside = outside, tables[-1]
    forget(*tables)
    return levels


def cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> list[Level]:
    """Levels that tell the listed keys from all others of the universe; both have one string column `key`, which may repeat."""
    listed = listed.where("key is not null").distinct()
    first = first_level(listed, n_universe)
    return with_further_levels(listed, first, universe.where(passes(F.col("key"), first)).distinct() if first else universe)


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: it is if the first level that it fails is an even one."""
    found = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        found = F.when(passes(key, level), found).otherwise(F.lit(level.number % 2 == 0))
    return found


def _cascades(keys: DataFrame, listed: dict[str, DataFrame], n: int) -> dict[str, list[Level]]:
    """The cascade of each verdict's keys, from one pass over the candidate keys, of which there are n at most."""
    firsts = {v: first_level(x, n) for v, x in listed.items()}
    through = {v: passes(F.col("key"), level) if level else F.lit(False) for v, level in firsts.items()}
    passed = written(keys.select("key", *[c.alias(v) for v, c in through.items()]).where("allow or block").distinct())
    found = {v: with_further_levels(x, firsts[v], passed.where(v).select("key")) for v, x in listed.items()}
    forget(passed)
    return found


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", keys_a_pass: int = KEYS_A_PASS) -> DataFrame:
    """A row for each row of pages: the id, host, path, rule (host and path of the longest that fits, else null) and verdict.

    rules has string columns verdict (allow or block), host and path; a key listed under both counts as allow, and of
    rules of equal length the one with the longer host wins. A url that is null or has no `://` has an empty host and
    path and the default verdict. Rows with equal or null ids are kept; other columns of pages are not carried. Urls
    may be of any length; an empty table gives no rows.

    The filters' words, about log2(candidates / listed keys) / 0.7 bits for each listed key, pass through the driver
    and stand in the plan as literals. So that those stay bounded, a list of more than `keys_a_pass` keys is dealt by
    hash into shares of about as many. Each share has cascades of its own over the candidates with such hashes, and a
    pass that notes which of a url's candidates it lists; passes grow with the list, memory doesn't.
    """
    # as many rows as there are kinds of rules
    shapes = rules.where("host is not null and path is not null").select(F.size(F.split("host", "\\.")).alias("labels"), F.char_length("path").alias("length")).distinct().collect()
    counts, lengths = ({r[c] for r in shapes} for c in ("labels", "length"))
    parts = pages.select(F.col(id_col).cast("long").alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    # an upper bound, so that pages needn't be parsed to be counted
    n = pages.count() * max(1, len(counts)) * max(1, len(lengths))
    listed = {v: written(rules.where(F.col("verdict") == v).select(F.concat("host", "path").alias("key")).where("key is not null").distinct()) for v in ("allow", "block")}
    shares = max(1, *[-(-x.count() // keys_a_pass) for x in listed.values()])
    tried = candidates(F.col("host"), F.col("path"), counts, lengths)
    if shares == 1:
        levels = _cascades(parts.select(F.explode(tried).alias("key")), listed, n)
        lists = {v: partial(member, levels=x) for v, x in levels.items()}
    else:
        parts, lists = _noted(parts, tried, listed, n, shares)
    forget(*listed.values())
    fits = F.filter(tried, lambda k: lists["allow"](k) | lists["block"](k))
    longest = F.aggregate(fits, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.char_length(b) > F.char_length(a)), b).otherwise(a))
    judged = parts.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), default).when(lists["allow"](F.col("rule")), "allow").otherwise("block")
    return judged.withColumn("verdict", verdict).select(id_col, "host", "path", "rule", "verdict")


def _noted(parts: DataFrame, tried: Column, listed: dict[str, DataFrame], n: int, shares: int) -> tuple[DataFrame, dict[str, Callable[[Column], Column]]]:
    """The rows with what is listed of their candidates, share by share, and for each verdict the test of a key by it.

    A row's notes are some of its own candidates, so they don't grow with the lists."""
    share = lambda k: F.pmod(F.xxhash64(k), F.lit(shares))
    notes = {v: f"__{v}" for v in listed}
    parts = written(parts.withColumns({c: F.array().cast("array<string>") for c in notes.values()}))
    for s in range(shares):
        keys = parts.select(F.explode(tried).alias("key")).where(share(F.col("key")) == s)
        levels = _cascades(keys, {v: x.where(share(F.col("key")) == s) for v, x in listed.items()}, -(-n // shares))
        tests = {v: partial(member, levels=x) for v, x in levels.items()}
        mine = F.filter(tried, lambda k: share(k) == s)
        before, parts = parts, written(parts.withColumns({c: F.concat(c, F.filter(mine, lambda k: tests[v](k))) for v, c in notes.items()}))  # noqa: B023  called at once
        forget(before)
    return parts, {v: lambda k, c=c: F.array_contains(F.col(c), k) for v, c in notes.items()}
