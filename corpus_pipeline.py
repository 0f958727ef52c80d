"""A corpus pipeline: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import forget, free_name, small_batches, table, written
from rasterloom.llm.entry import labelled_quality
from rasterloom.llm.language import fit_language, identify_language
from rasterloom.llm.neardup import without_near_duplicates as drop_near_duplicates
from rasterloom.llm.packing import best_fit_packing
from rasterloom.llm.quality import fit_voters, quality_scores

#: No SQL expresses the fitted models of the first stages.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from labels, predicts as good; without labels, all of them.

    A score of 0.3 is good. Null texts are scored as empty ones; rows with equal or null ids are judged one by one; an
    empty table gives no rows."""
    small_batches(spark)
    voters = fit_voters(labelled_quality(docs, table(spark, sf_dir, "labels")))
    score, good = (free_name(docs, c) for c in ("score", "predicted"))
    judged = quality_scores(docs, voters, 0.3, keep=True, names=(score, good))
    return judged.where(F.col(good) == 1).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, learned from lang, doesn't reject; without any to learn from, all of them.

    Null texts and texts without a letter are rejected, whatever their lang says. A confidence at the threshold is
    enough; rows with equal or null ids are judged one by one; an empty table gives no rows."""
    small_batches(spark)
    model = fit_language(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    if model is None:
        return docs
    language, score, rejected = (free_name(docs, c) for c in ("lang_pred", "score", "rejected"))
    return identify_language(docs, model, keep=True, names=(language, score, rejected)).where(~F.col(rejected)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts and of texts that share 0.8 of their five-word shingles or more, as
    SimHash and min-wise hashes propose them: that with the smallest id. Of rows without an id, those stay whose group
    has no other."""
    small_batches(spark)
    return drop_near_duplicates(docs, 5, 0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    small_batches(spark)
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", without_near_duplicates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
