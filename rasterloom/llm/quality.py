"""Quality by nearest-neighbour voting in a latent-semantic space.

Hashed byte n-grams, their largest shares in order, and how often a word repeats the one before it describe a text. A
bounded sample of labelled texts gives the latent directions by singular value decomposition; their vectors, of a
size that the sample's bound fixes, are broadcast, and every document is compared with all of them by blocked
products. The labels of the nearest ones vote, weighted by a power of the cosine.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rasterloom.llm.common import free_name, hash_sample
from rasterloom.llm.features import ngram_counts

ORDERS, BITS, TOP = (1, 3), 11, 32
#: Labelled rows that the model is fitted on, at most; the broadcast holds SAMPLE * DIMENSIONS numbers.
SAMPLE, DIMENSIONS = 3000, 64
ITERATIONS = 6
NEIGHBOURS, POWER = 11, 16
BLOCK = 256


def describe(text: bytes) -> np.ndarray:
    """Square roots of the shares of n-grams, the largest of them in order, and of the share of repeated words."""
    counts = ngram_counts(text, ORDERS, BITS)
    shares = np.sqrt(counts / max(1, counts.sum()))
    top = -np.sort(-np.partition(shares, len(shares) - TOP)[-TOP:])
    words = text.split()
    repeats = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    return np.concatenate([shares, top, [repeats**0.5]]).astype(np.float32)


class Voters(NamedTuple):
    mean: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray  # unit length
    labels: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest voters; without voters, a half."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        z = (x - self.mean) @ self.directions
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        cosines = z @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, nearest, 1), 1e-3).astype(np.float64) ** POWER
        return np.clip((weights * self.labels[nearest]).sum(1) / weights.sum(1), 0, 1)


def leading_directions(x: np.ndarray, k: int) -> np.ndarray:
    """Right singular vectors of the k largest singular values, by subspace iteration on a few more."""
    wide = min(k + 16, *x.shape)
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(1).normal(size=(x.shape[1], wide)).astype(np.float32)))[0]
    for _ in range(ITERATIONS):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v[:k].T).astype(np.float32)


def fit_voters(labelled: DataFrame, sample: int = SAMPLE) -> Voters:
    """From rows (id, text, label 0 or 1; others are left out), of which the first `sample` by the hash of the id count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [describe(x.as_py() or b"").astype(np.float16).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["x", "label"])

    rows = labelled.where("label in (0, 1)").select("id", F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"))
    picked = hash_sample(rows, sample, "id", F.xxhash64("text"), "label").select("text", "label")
    found = picked.mapInArrow(run, "x binary, label int").collect()  # bounded by the sample
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32).reshape(-1, (1 << BITS) + TOP + 1)
    if not len(x):
        return Voters(np.zeros(x.shape[1], np.float32), np.zeros((x.shape[1], 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0))
    mean = x.mean(0)
    directions = leading_directions(x - mean, DIMENSIONS)
    z = (x - mean) @ directions
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return Voters(mean, directions, z, np.array([r["label"] for r in found], float))


def quality_scores(docs: DataFrame, voters: Voters, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """A row for each row of docs: id, score (0 to 1, higher: likelier label 1), predicted (1 at the threshold or above).

    A null text counts as empty, and empty texts are scored like any other. keep: all columns of docs instead of the
    id alone, before score and predicted, which are called by `names` and replace columns of those names. Equal or
    null ids are kept. Whole texts count, however long; of voters at equal cosines any may vote. Without voters every
    score is a half; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts, score = batch.column(batch.num_columns - 1), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, BLOCK):
                x = np.array([describe(t.as_py() or b"") for t in texts[at : at + BLOCK]])
                score[at : at + BLOCK] = model.scores(x)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            predicted = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), predicted], [*batch.schema.names[:-1], *names])

    text = docs[text_col].cast("binary").alias(free_name(docs, "text_bytes"))
    kept = [docs[c] for c in docs.columns if c not in names] if keep else [docs[id_col].cast("long").alias(id_col)]
    rows = docs.select(*kept, text)
    kinds = StructType([*rows.schema[:-1], StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    return rows.mapInArrow(run, kinds)
