"""Clashing names, missing labels, broken media, and the classifiers against slow versions of themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import entry, language, media, quality, tokencounts
from rasterloom.llm.common import hash_sample
from rasterloom.llm.features import _ODD


def slow_counts(text, orders, bits):
    """Counts of hashed byte n-grams, one at a time."""
    out, data = {}, b" " + text + b" "
    for n in orders:
        for i in range(len(data) - n + 1):
            h = n
            for k in range(n):
                h = (h ^ data[i + k]) * int(_ODD[k]) & 0xFFFFFFFF
                h ^= h >> 15
            out[h >> 32 - bits] = out.get(h >> 32 - bits, 0) + 1
    return out


def test_language_against_one_text_at_a_time(spark, odd_docs, odd_texts):
    model = language.fit_language(odd_docs.selectExpr("doc_id AS id", "text", "lang AS label"))
    texts = [t for t in odd_texts if t and len(t) < 3000 and any(c.isalpha() for c in t)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    for i, t in enumerate(texts):
        counts = slow_counts(t.lower().encode() if t.isascii() else t.encode().lower(), language.ORDERS, language.BITS)
        total = sum(counts.values())
        z = [(sum(n / total * float(model.logits[b, k]) for b, n in counts.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        assert abs(found[i]["score"] - max(p)) < 1e-3
        if abs(p[0] - p[1]) > 0.01:
            assert found[i]["lang_pred"] == model.languages[int(np.argmax(p))]


def test_quality_against_all_cosines(spark, odd_docs, odd_texts):
    voters = quality.fit_voters(odd_docs.selectExpr("doc_id AS id", "text", "cast(doc_id % 2 AS int) AS label"))
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, voters).collect()}
    for i, t in enumerate(odd_texts):
        z = (quality.describe((t or "").encode()).astype(float) - voters.mean) @ voters.directions.astype(float)
        z /= max(np.linalg.norm(z), 1e-9)
        votes = sorted(((float(z @ v), float(y)) for v, y in zip(voters.vectors, voters.labels, strict=True)), reverse=True)
        if votes[quality.NEIGHBOURS - 1][0] - votes[quality.NEIGHBOURS][0] > 1e-4:
            weights = [max(c, 1e-3) ** quality.POWER for c, _ in votes[: quality.NEIGHBOURS]]
            want = sum(w * y for w, (_, y) in zip(weights, votes, strict=False)) / sum(weights)
            assert abs(found[i] - want) < 1e-3


def test_stages_return_the_input_columns_as_they_were(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    names = ["score", "predicted", "lang_pred", "rejected", "text_bytes", "has_letters", "__text", "none", "id_", "h", "key"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_stages_without_labels_keep_all(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some text {i}", None, "s", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.good_quality(spark, docs, str(tmp_path)).count() == 20
    assert corpus_pipeline.known_language(spark, docs, str(tmp_path)).count() == 20


def test_null_ids_are_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 2 else i, f"some text {i}", "en", "s", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (entry.op3_language, entry.op6_quality, entry.op7_lm):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == 20 and not any(r["held_out"] for r in rows if r["doc_id"] is None) and all(r["held_out"] is not None for r in rows)


def test_large_samples_are_full(spark):
    rows = spark.range(13_000)
    for key in (F.lit(None).cast("long"), F.lit(3).cast("long"), F.col("id") % 3, F.col("id")):
        assert hash_sample(rows.select(key.alias("k"), F.col("id").alias("t")), 3000, "k", "t").count() == 3000


@pytest.mark.parametrize("data", [b"P2 1 1 255\n70000", b"P2 1 1 255\n300", b"P2 1 1 255\n-1", b"P5 0 0 255\n", b"P5 99999999 99999999 255\n\0", b"P5 1 1 0\n\0", b"P5 1 1 70000\n\0\0", b"P2 1 1 255\nx", b"BM", b"", None])
def test_broken_media_are_rows(spark, data):
    (row,) = media.media_tiles(spark.createDataFrame([("a", data)], "id string, media binary")).collect()
    assert row["id"] == "a" and row["error"] and row["tile"] is None


def test_colours_of_16_bits(spark):
    one = b"P6 1 1 65535\n" + np.array([1000] * 3, ">u2").tobytes()
    assert int(media.to_grey(media.decode(one))[0, 0]) == 1000
    (row,) = media.media_tiles(spark.createDataFrame([("a", one)], "id string, media binary"), height=1, width=1).collect()
    assert row["error"] is None and int(media.from_npy(row["tile"])[0, 0]) == 1000


def test_counts_without_a_fitting_token(monkeypatch):
    """Where the rule of pairs finds nothing, the library's counts stand."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = tokencounts.PrefixCounts(tokencounts.pieces(path))
    chunks = ["▁the", "▁there", "▁other", "▁othello"]
    want = model.steps(chunks)
    none = tokencounts.PrefixCounts(tokencounts.pieces(path))
    monkeypatch.setattr(none, "fits", lambda *_: False)
    got = none.steps(chunks)
    assert [sum(x) for x in got] == [sum(x) for x in want] == [len(model.tokens(c)) for c in chunks]
