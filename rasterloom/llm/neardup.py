"""Near-duplicate texts: SimHash by Golay codes takes off the close copies, min-wise hashes find the rest, and the
shingles of every pair that either proposes are compared exactly.

SimHash alone can't give right results for texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8:
their fingerprints differ in a bit with probability acos(2 J / (1 + J)) / pi, 0.15, so in ten of 64 bits, where Golay
keys reach four. But copies with few changes, of which large groups consist, are within four bits by fingerprints of
short shingles; they become one component each by a star around the group's centre, as in the operator `simhash`.

Two texts agree in a min-wise hash as often as their sets of shingles overlap, whatever edit made one of the other. A
text has BANDS keys of ROWS hashes each, and texts that share a key are compared: of pairs at a similarity of 0.8,
three in a million share none. Every pair of texts of a key is compared unless the two are connected already. So that
a dense group proposes few pairs, two passes over some bands each compare texts with one centre of their key first,
the text that agrees with most of its others, and one pass compares each text with that of its key which agrees
with it most; all pairs of a key whose texts are still in different groups follow, crowded keys in blocks. Wide
signatures tell most strangers of a key apart before their texts are read. What is proposed counts only if the
shingles are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import each_run, forget, free_name, written
from rasterloom.llm.components import connected_components
from rasterloom.llm.simhash import fingerprint, fingerprint_links

#: A pair of similarity J shares no key with probability (1 - J ** ROWS) ** BANDS.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes of the signatures of texts that share a key, by which pairs are told apart before their texts are read.
WIDE = 1024
#: Odd multipliers: each makes another order of the hashes of shingles.
ORDERS = np.random.default_rng(1).integers(0, 1 << 31, WIDE, np.uint32) * np.uint32(2) + np.uint32(1)
#: Standard deviations below its mean at which the number of equal hashes of a pair is too small for the pair to be read.
SPREADS = 4.5
#: Words to a shingle, and bits that may differ, of the fingerprints; no result depends on them.
FINGERPRINT_WORDS, FINGERPRINT_BITS = 2, 4
#: The first bands, whose keys' central texts are compared together with close copies, before those of all others.
FIRST = 8
#: Texts of a key that a task compares with each other at once.
BLOCK = 1024
STRIDE = 4096


def shingles(text: bytes, size: int) -> set:
    """Tuples of so many words in a row, A-Z in lower case; of fewer words, all of them."""
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)}


def similarity(a: bytes, b: bytes, size: int) -> float:
    x, y = shingles(a, size), shingles(b, size)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def signature(text: bytes, size: int, hashes: int = HASHES) -> bytes:
    """A byte of each of the first `hashes` min-wise hashes of the shingles."""
    parts = list(map(b" ".join, shingles(text, size)))
    values = np.fromiter(map(xxhash.xxh32_intdigest, parts), np.uint32, len(parts))
    least, orders = np.full(hashes, (1 << 32) - 1, np.uint32), ORDERS[:hashes, None]
    step = STRIDE * HASHES // hashes
    for at in range(0, len(values), step):
        np.minimum(least, (orders * values[at : at + step]).min(1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, h, fp, sig): h names a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            fps = np.array([fingerprint(x, FINGERPRINT_WORDS) for x in texts], np.uint64).view(np.int64)
            found = pa.array([signature(x, shingle) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), found], ["id", "h", "fp", "sig"])

    return docs.mapInArrow(run, "id long, h long, fp long, sig binary")


def _wide(texts: DataFrame, shingle: int) -> DataFrame:
    """(h, sig): wide signatures of rows (h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([signature(x.as_py(), shingle, WIDE) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["h", "sig"])

    return texts.select("h", "text").mapInArrow(run, "h long, sig binary")


def _matrix(signatures: pa.Array, hashes: int = HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, hashes)


def _enough(least: float, hashes: int) -> float:
    return hashes * least - SPREADS * (hashes * least * (1 - least)) ** 0.5


def _key_rows(distinct: DataFrame) -> DataFrame:
    """(key, h) for each band of rows (h, sig); a band's number stands above its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _matrix(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.int64)
            keys = (parts << np.arange(ROWS) * 8).sum(axis=2) | np.arange(BANDS) << 8 * ROWS
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "h"])

    return distinct.select("h", "sig").mapInArrow(run, "key long, h long")


def _pairs(live: DataFrame, wide: DataFrame, least: float, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of texts of rows (key, n, h, comp) that share a key, whose comp differs and whose signatures may be
    those of similar texts. A pair comes of the first key that it shares only. nearest: of each text's pairs in a key
    (or in two of its blocks), only that with the most equal hashes, so pairs are as few as the rows."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("h"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, own).alias("p"), F.greatest(b, own).alias("q")))
    dealt = live.select("key", own.alias("block"), "h", "comp", F.explode(others).alias("o")).select("key", "o.*", "block", "h", "comp")
    rows = dealt.join(wide, "h").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    def compare(t: pa.Table) -> pa.RecordBatch:
        band = t["key"][0].as_py() >> 8 * ROWS
        block, h, comp, sig = t["block"].to_numpy(), t["h"].to_numpy(), t["comp"].to_numpy(), _matrix(t["sig"], WIDE)
        x, y = np.flatnonzero(block == t["p"][0].as_py()), np.flatnonzero(block == t["q"][0].as_py())
        equal = np.zeros((len(x), len(y)), np.uint8)
        if len(x) * len(y) <= 4096:
            equal = (sig[x, :HASHES][:, None] == sig[y, :HASHES][None]).sum(axis=2)
        else:
            for k in range(HASHES):
                equal += sig[x, k][:, None] == sig[y, k]
        near = (equal >= _enough(least, HASHES)) & (comp[x][:, None] != comp[y])
        if t["p"][0] == t["q"][0]:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        equal = np.zeros(near.shape, np.int32)
        for at in range(0, len(i), STRIDE):
            u, v = i[at : at + STRIDE], j[at : at + STRIDE]
            equal[u, v] = (sig[x[u]] == sig[y[v]]).sum(axis=1)
        near &= equal >= _enough(least, WIDE)
        if nearest and near.any():
            value = np.where(near, equal, 0)
            near = np.zeros_like(near)
            near[np.arange(len(x)), value.argmax(axis=1)] = True
            near[value.argmax(axis=0), np.arange(len(y))] = True
            near &= value > 0
        i, j = np.nonzero(near)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(i), STRIDE):
            u, v = x[i[at : at + STRIDE]], y[j[at : at + STRIDE]]
            first = nearest | ((sig[u, :HASHES] == sig[v, :HASHES]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)
            a.append(h[u[first]])
            b.append(h[v[first]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.select("key", "p", "q", "block", "h", "comp", "sig").mapInArrow(each_run(["key", "p", "q"], compare), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similarity(x.as_py(), y.as_py(), size) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            kept = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["u", "v"])

    # texts are large and pairs may be many: both are dealt, alike at every size
    both = pairs.hint("merge").join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a")
    both = both.hint("merge").join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def _shared(distinct: DataFrame) -> DataFrame:
    """(key, n, h): rows of the keys that n texts share."""
    keys = _key_rows(distinct)
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _live(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n, h, comp): rows of the keys whose texts aren't all known to be connected by labels (node, root)."""
    rows = shared.join(labels.withColumnRenamed("node", "h"), "h", "left").select("key", "n", "h", F.coalesce("root", "h").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return rows.join(mixed, "key")


def _stars(live: DataFrame, distinct: DataFrame) -> DataFrame:
    """For each text of rows (key, n, h, comp), the pair (a, b) with the centre of its most crowded key: the text that
    agrees best with what most texts of the key have, or of a block of them."""

    def centre(t: pa.Table) -> pa.RecordBatch:
        sig, h, comp = _matrix(t["sig"]), t["h"].to_numpy(), t["comp"].to_numpy()
        most = np.array([np.bincount(sig[:, k]).argmax() for k in range(HASHES)], np.uint8)
        agree = (sig == most).sum(axis=1)
        k = np.lexsort((h, -agree))[0]
        return pa.RecordBatch.from_pydict({"key": t["key"][:1].combine_chunks(), "b": pa.array([h[k]]), "other": pa.array([comp[k]]), "agree": pa.array([int(agree[k])])})

    blocks = F.ceil(F.col("n") / BLOCK)
    rows = live.withColumn("block", F.pmod(F.xxhash64("h"), blocks)).join(distinct.select("h", "sig"), "h")
    dealt = rows.select("key", "block", "h", "comp", "sig").repartition("key", "block").sortWithinPartitions("key", "block")
    found = dealt.mapInArrow(each_run(["key", "block"], centre), "key long, b long, other long, agree long")
    centres = found.groupBy("key").agg(F.max_by(F.struct("b", "other"), F.struct("agree", "b")).alias("c")).select("key", "c.*")
    return live.join(centres, "key").where("comp <> other").groupBy(F.col("h").alias("a")).agg(F.max_by("b", F.struct("n", "key")).alias("b"))


def _close_copies(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (h, fp) with one fingerprint or close ones: each with one text that stands for it."""
    leads = written(distinct.groupBy("fp").agg(F.min("h").alias("lead")))
    links = written(fingerprint_links(leads.select(F.lit(0).alias("kind"), "fp"), FINGERPRINT_BITS).select("u", "v"))
    # of the centres that tasks have linked a fingerprint with, the one linked most
    popular = links.groupBy("v").agg(F.count("*").alias("n"))
    stars = links.join(popular, "v").groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    named = stars.join(leads.select(F.col("fp").alias("u"), F.col("lead").alias("a")), "u").join(leads.select(F.col("fp").alias("v"), F.col("lead").alias("b")), "v")
    equal = distinct.join(leads, "fp").where("h <> lead").select(F.col("h").alias("a"), F.col("lead").alias("b"))
    pairs = written(equal.union(named.select("a", "b")))
    forget(leads, links)
    return pairs


def _groups(docs: DataFrame, shingle: int, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Tables, written: (id, h) of each row; (h, first, comp) of each distinct text, by its smallest id and its group."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    signed = written(_signatures(rows, shingle))
    found = written(signed.select("id", "h"))
    distinct = written(signed.groupBy("h").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("sig").alias("sig")))
    forget(signed)
    shared, close = written(_shared(distinct)), _close_copies(distinct)
    named = shared.select("h").union(close.select(F.col("a").alias("h"))).union(close.select("b")).distinct()
    # written once: of all texts, those that something proposes
    texts = written(rows.join(named, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")))
    wide = written(_wide(texts, shingle))

    in_first = F.col("key") < FIRST << 8 * ROWS
    alone = distinct.select(F.col("h").alias("node"), F.col("h").alias("root")).limit(0)
    pairs = written(close.union(_stars(_live(shared.where(in_first), alone), distinct).select("a", "b")).distinct())
    forget(close)
    stars = written(_verified(pairs, texts, shingle, least))
    forget(pairs)
    # what a text was found similar to stands for its group in the next pass
    nearest = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    pairs = written(_stars(_live(shared.where(~in_first), nearest), distinct))
    more = written(_verified(pairs, texts, shingle, least))
    forget(pairs)
    roots = connected_components(stars.union(more))
    forget(stars, more)

    for nearest in (True, False):
        pairs = written(_pairs(_live(shared, roots), wide, least, nearest).distinct())
        if not pairs.limit(1).count():  # then no two texts of a key are left to compare
            forget(pairs)
            break
        # a root stands for its group
        trees = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        before, roots = roots, connected_components(trees.union(_verified(pairs, texts, shingle, least)))
        forget(before, pairs)
    named = distinct.select("h", "first").join(roots.withColumnRenamed("node", "h"), "h", "left")
    groups = written(named.select("h", "first", F.coalesce("root", "h").alias("comp")))
    forget(shared, texts, wide, roots, distinct)
    return found, groups


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id and component_id, the smallest id of its group of equal or similar texts.

    Groups are connected by pairs whose sets of shingles have a similarity (Jaccard) of `least` or more, if they share
    one of their keys. A null text counts as empty; empty texts are equal. Whole texts count, however long. Rows with
    equal ids are kept; null ids are never a component_id unless a group has no other. Other columns are not carried;
    an empty table gives no rows.
    """
    found, groups = _groups(docs, shingle, least, id_col, text_col)
    # only texts of groups of several need their group's smallest id looked up
    several = groups.where("h <> comp").select("comp").distinct()
    least_id = groups.join(several, "comp", "left_semi").groupBy("comp").agg(F.min("first").alias("least"))
    named = groups.join(least_id, "comp", "left").select("h", F.coalesce("least", "first").alias("component_id"))
    return found.join(named, "h").select(F.col("id").alias(id_col), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that stay: of each group of equal or similar texts, as `near_duplicates`
    connects them, the row with the smallest id.

    Rows are told apart by their text and id together: rows with one id but texts of different groups all stay, and of
    rows equal in both, one stays. Null ids come last: such a row stays if its group has no other. A null text counts
    as empty, so of null and empty texts one row stays. An empty table gives no rows.
    """
    found, groups = _groups(docs, shingle, least, id_col, text_col)
    forget(found)
    picked = groups.groupBy("comp").agg(F.min_by(F.struct("h", "first"), F.struct(F.col("first").isNull(), "first", "h")).alias("p")).select("p.*")
    h, none, id_ = (free_name(docs, c) for c in ("h", "none", "id_"))
    key = docs[id_col].cast("long")
    rows = docs.withColumns({h: F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), none: key.isNull(), id_: F.coalesce(key, F.lit(0))})
    # equal rows meet here, after each task has taken its own together
    rows = rows.dropDuplicates([h, none, id_])
    stay = picked.select(F.col("h").alias(h), F.col("first").isNull().alias(none), F.coalesce("first", F.lit(0)).alias(id_))
    # what stays grows with the corpus: it is dealt like the documents, never broadcast
    return rows.hint("merge").join(stay, [h, none, id_], "left_semi").select(*docs.columns)
