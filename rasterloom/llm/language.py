"""Language identification by averaged hashed subword embeddings with a linear softmax.

Every byte n-gram of two to four bytes has an embedding; a text's is their average, and a linear softmax names the
language or says that it is none of those known. Stochastic gradient descent in numpy learns both from a bounded sample.
What no known language is like comes from the sample itself: its texts with letters exchanged for others, consonants for
consonants as in a language that doesn't exist, put into another script, shuffled or replaced by hex digits. A part of the
sample that it doesn't see calibrates the confidence by a temperature, and the confidence under which a text is rejected
is set from both sides: by the known texts that it would lose and the invented ones that it would let pass.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from rasterloom.llm.common import free_name, hash_sample
from rasterloom.llm.features import ngram_counts

ORDERS, BITS = (2, 3, 4), 12
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 3000
DIMENSIONS, EPOCHS, RATE, MINI = 16, 20, 2.0, 32
#: A known text that is rejected counts like this many invented ones that pass.
KNOWN_WEIGHT = 50
#: Words of a part of a text, from which shorter examples are learned, by their least and greatest number.
PART_WORDS = (8, 60)
#: Letters of invented languages, and the first letter of runs of 48 in other scripts.
VOWELS, CONSONANTS = "aeiouyäöåéóúąęõ", "bcdfghjklmnpqrstvwxzčšžłśżñðř"
SCRIPTS = (0x3B1, 0x430, 0x561, 0x5D0, 0x627, 0x915, 0xE01, 0x10D0, 0x3042, 0xAC00)
#: Of ideographs there are so many that every letter of a text becomes one of a different few.
IDEOGRAPHS = (0x4E00, 0x9F00)


class LanguageModel(NamedTuple):
    languages: list[str]  # known ones; the softmax has one class more, for none of them
    logits: np.ndarray  # of each bucket: its embedding times the softmax's weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, shares: np.ndarray) -> np.ndarray:
        """Of each known language; what is missing to one is that of none."""
        return _softmax((shares @ self.logits + self.bias) / self.temperature)[:, :-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _shares(text: bytes) -> np.ndarray:
    counts = ngram_counts(text.lower(), ORDERS, BITS)
    return (counts / max(1, counts.sum())).astype(np.float32)


def _part(text: str, rng: np.random.Generator) -> str:
    """A run of its words, or all if there are few."""
    words = text.split()
    n = int(rng.integers(PART_WORDS[0], PART_WORDS[1] + 1))
    at = int(rng.integers(0, max(1, len(words) - n + 1)))
    return " ".join(words[at : at + n])


def invented(text: str, rng: np.random.Generator) -> str:
    """The text as no known language has it, in one of five ways."""
    text, way = text.lower(), int(rng.integers(0, 8))
    letters = sorted({c for c in text if c.isalpha()})
    if way < 4:  # a language that doesn't exist; most often, since real ones that aren't known are like it
        kinds = [[c for c in letters if (unicodedata.normalize("NFD", c)[0] in "aeiouy") == vowel] for vowel in (True, False)]
        table = {c: alphabet[int(k)] for found, alphabet in zip(kinds, (VOWELS, CONSONANTS), strict=True) for c, k in zip(found, np.resize(rng.permutation(len(alphabet)), len(found)), strict=True)}
        for c in rng.permutation(letters)[: int(rng.integers(0, 4))]:
            table[c] *= 2
        return text.translate({ord(c): t for c, t in table.items()})
    if way == 4:
        drawn = rng.permutation(list(text))
        return "".join(drawn.tolist())
    if way == 5:
        return "".join(rng.choice(list("0123456789abcdef"), len(text)).tolist())
    if way == 6:
        base = SCRIPTS[int(rng.integers(0, len(SCRIPTS)))]
        return text.translate({ord(c): chr(base + int(k)) for c, k in zip(letters, np.resize(rng.permutation(48), len(letters)), strict=True)})
    signs = rng.integers(*IDEOGRAPHS, 400)
    return "".join(chr(int(signs[zlib.crc32(w.encode()) % 400])) for w in text.split())


def examples(text: str) -> list[tuple[str, bool]]:
    """What is learned from a text: (text, whether it is of the text's language). The whole comes first; the same text
    always gives the same."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    part = _part(text, rng)
    return [(text, True), (part, True), (invented(text if rng.random() < 0.5 else part, rng), False)]


def _threshold(known: np.ndarray, strange: np.ndarray) -> float:
    """The confidence that costs least: 0, or midway by the odds between two that were seen; of equally good ones the lowest."""
    p = np.clip(np.sort(np.concatenate([known, strange]).astype(float)), 1e-9, 1 - 1e-9)
    odds = np.log(p) - np.log1p(-p)
    middles = (odds[1:] + odds[:-1]) / 2
    tried = np.r_[0.0, 1 / (1 + np.exp(-middles))]  # 0 rejects nothing
    lost = np.searchsorted(np.sort(known), tried) / max(1, len(known))
    passed = 1 - np.searchsorted(np.sort(strange), tried) / max(1, len(strange))
    return float(tried[np.argmin(KNOWN_WEIGHT * lost + passed)])


def train(x: np.ndarray, labels: list[str | None], texts: np.ndarray, seed: int = 1) -> LanguageModel:
    """x: shares of n-grams; labels: languages, null for invented texts; texts: from which text each row comes, of whose
    rows the first is the whole. A fifth of the texts calibrates."""
    languages = sorted({v for v in labels if v is not None})
    none = len(languages)
    y = np.array([none if v is None else languages.index(v) for v in labels], int)
    rng = np.random.default_rng(seed)
    n = int(texts.max()) + 1
    held_texts = np.zeros(n, bool)
    if n >= 50:
        held_texts[rng.permutation(n)[: n // 5]] = True
    held = np.flatnonzero(held_texts[texts]) if n >= 50 else np.arange(len(y))
    learn = np.flatnonzero(~held_texts[texts])
    scale = 1 / np.sqrt(DIMENSIONS)
    embedding = rng.normal(0, scale, (x.shape[1], DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, none + 1), np.float32), np.zeros(none + 1, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for _ in range(0, len(learn), MINI):
            rows = rng.choice(learn, min(MINI, len(learn)), replace=False)
            a, t = x[rows].astype(np.float32), y[rows]
            hidden = a @ embedding
            p = _softmax(hidden @ weights + bias)
            p[np.arange(len(t)), t] -= 1
            p /= len(t)
            back = p @ weights.T
            weights -= rate * hidden.T @ p
            bias -= rate * p.sum(0)
            embedding -= rate * 50 * (a.T @ back)  # a bucket's share is small, so its embedding moves more
    logits = embedding @ weights
    z = x[held].astype(np.float32) @ logits + bias

    # where no row is wrong, one that isn't there counts as such, or confidence would have no end
    target = np.full(z.shape, 1 / (len(held) + 2) / none)
    target[np.arange(len(held)), y[held]] = 1 - 1 / (len(held) + 2)

    def loss(t: float) -> float:
        p = z / t
        return float(-(target * (p - p.max(1, keepdims=True) - np.log(np.exp(p - p.max(1, keepdims=True)).sum(1, keepdims=True)))).sum(1).mean())

    model = LanguageModel(languages, logits, bias, float(min(np.geomspace(0.02, 50, 81), key=loss)), 0.0)
    first = np.r_[True, texts[1:] != texts[:-1]]
    p = model.probabilities(x[held].astype(np.float32))
    whole, strange = first[held], y[held] == none
    return model._replace(reject_below=_threshold(p[whole].max(1), p[strange].max(1)))


def fit_language(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """From rows (id, text, label), of which the first `sample` by the hash of the id count; null labels and texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                made = examples(text.as_py().decode(errors="replace"))
                x = [zlib.compress(_shares(t.encode()).astype(np.float16).tobytes(), 1) for t, _ in made]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array([label if own else None for _, own in made], pa.string()), pa.array([k == 0 for k in range(len(made))])], ["x", "label", "first"])

    rows = labelled.where("label is not null").select("id", F.col("text").cast("binary").alias("text"), F.col("label").cast("string").alias("label"))
    picked = hash_sample(rows, sample, "id", F.xxhash64("text"), "label").where("text is not null").select("text", "label")
    found = picked.mapInArrow(run, "x binary, label string, first boolean").collect()  # bounded by the sample
    if not found:
        return None
    x = np.empty((len(found), 1 << BITS), np.float16)  # stays in half precision
    for k, r in enumerate(found):
        x[k] = np.frombuffer(zlib.decompress(r["x"]), np.float16)
    labels, texts = [r["label"] for r in found], np.cumsum([r["first"] for r in found]) - 1
    del found  # or the driver holds everything twice while it learns
    return train(x, labels, texts)


def identify_language(
    docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")
) -> DataFrame:
    """A row for each row of docs: id, lang_pred, score (calibrated confidence) and rejected.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or no model could be learned; those and
    texts under the model's threshold are rejected. keep: all columns of docs before the three, which are called by
    `names` and replace columns of those names. Rows with equal or null ids are kept. Whole texts count, however long;
    of equally likely languages the first by name is told. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n = batch.num_columns - 2
            lang, score, rejected = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            usable = np.flatnonzero(batch.column(n + 1).to_numpy(zero_copy_only=False)) if m else []
            for at in range(0, len(usable), 256):
                rows = usable[at : at + 256]
                p = m.probabilities(np.array([_shares(batch.column(n)[int(i)].as_py()) for i in rows]))
                score[rows] = p.max(1)
                rejected[rows] = p.max(1) < m.reject_below
                for i, k in zip(rows, p.argmax(1), strict=True):
                    lang[i] = m.languages[k]
            kept = [batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names[:n], *names])

    text = docs[text_col]
    extra = [text.cast("binary").alias(free_name(docs, "text_bytes")), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(free_name(docs, "has_letters"))]
    kept = [docs[c] for c in docs.columns if c not in names] if keep else [docs[id_col].cast("long").alias(id_col)]
    rows = docs.select(*kept, *extra)
    kinds = StructType([*rows.schema[:-2], StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], BooleanType())])
    return rows.mapInArrow(run, kinds)
