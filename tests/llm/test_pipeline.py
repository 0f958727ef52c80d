import pandas as pd

import __spark_entry__ as entry
import corpus_pipeline
from rasterloom.llm import neardup
from rasterloom.llm import entry as llm
from tests.test_catalogue import same


def test_sql(spark):
    for name, sql in llm.SQL.items():
        same(spark, name, llm.QUERIES[name], sql, "/root/testdata/sf0.001")


def test_names():
    assert {n.split("_")[0] for n in llm.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(llm.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").quality
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas()
        if name != "packing":
            assert list(after.columns) == list(before.columns) and set(after.doc_id) <= set(before.doc_id)
        gone = set(before.doc_id) - set(after.doc_id)
        if name == "quality":
            known = [labels[i] for i in gone if i in labels.index]
            assert known and sum(known) <= 0.02 * len(known)
            assert (after.doc_id.map(labels) == 0).sum() <= 0.05 * (labels == 0).sum()
        elif name == "language":
            assert len(gone) <= 0.01 * len(before)
        elif name == "near_duplicates":
            texts = before.set_index("doc_id").text
            sets = {i: neardup.shingles(t.encode(), 5) for i, t in texts.items()}
            where: dict = {}
            for i in sorted(sets):
                for s in sets[i]:
                    where.setdefault(s, []).append(i)
            similar: dict = {}
            for ids in where.values():
                for i in ids:
                    for j in ids[:50]:
                        if i != j:
                            similar.setdefault(i, set()).add(j)
            near = {i: {j for j in js if neardup.similarity(texts[i].encode(), texts[j].encode(), 5) >= 0.8} for i, js in similar.items()}
            assert gone and all(near.get(i) for i in gone)
            kept = [i for i in after.doc_id if any(j in set(after.doc_id) for j in near.get(i, ()))]
            assert len(kept) <= 0.1 * len(gone)
            assert after.text.is_unique
    assert set(after.doc_id) == set(before.doc_id)


def test_near_duplicates_keep_odd_rows(spark, odd_docs):
    """Rows with one id and different texts are different documents; clashing names don't matter."""
    texts = {r["text"] or "" for r in odd_docs.collect()}
    kept = corpus_pipeline.without_near_duplicates(spark, odd_docs, "").toPandas()
    assert list(kept.columns) == odd_docs.columns
    assert kept.doc_id.isna().sum() == 1
    kept.text = kept.text.fillna("")
    assert not kept.text.duplicated().any(), kept[kept.text.duplicated(keep=False)].values
    assert set(kept.text) <= texts
    assert sorted(kept.text[kept.doc_id == 8]) == sorted(r["text"] for r in odd_docs.where("doc_id = 8").collect())
    assert corpus_pipeline.without_near_duplicates(spark, odd_docs.limit(0), "").count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Unique texts stay whatever ids they share; equal rows and copies become one row."""
    one, two, three = ("w%d x%d y%d z%d v%d u%d" % ((i,) * 6) for i in range(3))
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (2, three), (1, one), (None, one), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, one), (1, two), (2, three), (None, None)], docs.schema).collect()))
