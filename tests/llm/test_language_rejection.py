import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import language

FOLDER = "/root/testdata/sf0.01"
FINNISH = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Helsinki on Suomen pääkaupunki ja maan suurin kaupunki, joka sijaitsee etelässä meren rannalla.",
    "Talvella järvet jäätyvät ja lapset menevät ulos luistelemaan koulun jälkeen.", "Minun isoäitini leipoi joka lauantai ruisleipää vanhassa uunissa.",
    "Junat kulkevat aikataulun mukaan, mutta tänään ne ovat myöhässä lumen takia.",
]
RUSSIAN = [
    "Все люди рождаются свободными и равными в своём достоинстве и правах.", "Москва является столицей России и самым большим городом страны.",
    "Зимой озёра замерзают, и дети выходят кататься на коньках после школы.", "Моя бабушка каждую субботу пекла хлеб в старой печи.", "Поезда ходят по расписанию, но сегодня они опаздывают из-за снега.",
]
CHINESE = ["人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。", "北京是中国的首都,也是全国的政治文化中心。", "冬天湖面结冰,孩子们放学后去滑冰。", "我的祖母每个星期六都在旧炉子里烤面包。", "火车按照时刻表运行,但是今天因为下雪晚点了。"]
POLISH = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Warszawa jest stolicą Polski i największym miastem kraju nad Wisłą.",
    "Zimą jeziora zamarzają, a dzieci po szkole idą jeździć na łyżwach.", "Moja babcia w każdą sobotę piekła chleb w starym piecu.", "Pociągi jeżdżą według rozkładu, ale dzisiaj są spóźnione z powodu śniegu.",
]
KNOWN = [
    ("en", "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience."),
    ("fr", "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience."),
    ("de", "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt."),
    ("es", "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia."),
]


def strange() -> dict[str, list[str]]:
    r = random.Random(5)
    word = lambda: "".join(r.choices("bcdfghjklmnpqrstvwxz", k=r.randint(3, 9)))
    noise = {"gibberish": [" ".join(word() for _ in range(30)) for _ in range(50)], "hex": [" ".join(f"{r.getrandbits(32):08x}" for _ in range(20)) for _ in range(50)]}
    return {"Finnish": FINNISH, "Russian": RUSSIAN, "Chinese": CHINESE, "Polish": POLISH} | noise


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return language.fit_language(docs.selectExpr("doc_id AS id", "text", "lang AS label"))


def test_strange_texts_are_rejected_and_known_ones_are_not(spark, model):
    kinds = strange()
    rows = [(k, t) for k, texts in kinds.items() for t in texts]
    frame = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "doc_id long, kind string, text string")
    found = language.identify_language(frame, model, keep=True).toPandas()
    assert (found.groupby("kind").rejected.mean() >= 0.9).all() and set(found.lang_pred) <= set(model.languages)
    known = language.identify_language(spark.createDataFrame([(i, *r) for i, r in enumerate(KNOWN)], "doc_id long, lang string, text string"), model, keep=True).toPandas()
    assert (known["lang_pred"] == known["lang"]).all() and not known.rejected.any()
    whole = language.identify_language(spark.read.parquet(f"{FOLDER}/documents.parquet"), model).toPandas()
    assert whole.rejected.mean() <= 0.01


@pytest.mark.parametrize("left_out", ["de", "es", "fr"])
def test_a_language_that_was_left_out_is_rejected(spark, left_out):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    others = language.fit_language(docs.where(F.col("lang") != left_out).selectExpr("doc_id AS id", "text", "lang AS label"))
    assert left_out not in others.languages
    found = language.identify_language(docs.where(F.col("lang") == left_out), others).toPandas()
    assert found.rejected.mean() >= 0.9


def test_pipeline_stage_drops_planted_foreign_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    planted = [t for texts in strange().values() for t in texts]
    rows = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(planted)), "text": planted})
    more = spark.createDataFrame(rows).select(*[F.col(c).cast(docs.schema[c].dataType) if c in rows else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    kept = {r[0] for r in corpus_pipeline.known_language(spark, docs.union(more), FOLDER).select("doc_id").collect()}
    assert len(kept & set(rows.doc_id)) <= len(planted) // 10
    assert len(kept - set(rows.doc_id)) >= 0.99 * docs.count()


def test_threshold_and_calibration_with_little_to_go_by():
    assert 0.2 < language._threshold(np.array([0.8, 0.9]), np.array([0.1, 0.2])) < 0.8
    # one of a hundred known texts is worth less than most of the invented ones, one of ten is not
    assert language._threshold(np.r_[0.1, np.full(999, 0.9)], np.full(50, 0.5)) > 0.5 > language._threshold(np.r_[0.1, np.full(9, 0.9)], np.full(50, 0.5))
    assert language._threshold(np.array([0.5, 0.5]), np.array([0.5])) <= 0.5
    text = "Quelques mots, où l'on voit des lettres accentuées."
    assert language.examples(text) == language.examples(text) and language.examples("") != [] and language.examples("123 456")[0] == ("123 456", True)
    model = language.train(np.eye(4, dtype=np.float32)[[0, 1, 2]], ["a", "a", None], np.zeros(3, int))
    p = model.probabilities(np.eye(4, dtype=np.float32))
    assert model.languages == ["a"] and p.shape == (4, 1) and np.isfinite(p).all() and 0 <= model.reject_below <= 1
