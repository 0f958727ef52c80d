import random

import pytest

from rasterloom.llm import neardup


def words(rnd, n):
    return [f"w{rnd.randrange(10**7)}" for _ in range(n)]


def components(spark, texts):
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}


@pytest.mark.parametrize("block", [2, 1024])
def test_pairs_beside_strangers_of_the_same_words(spark, monkeypatch, block):
    """Texts of the same distinct words in other orders are strangers; each has one near copy."""
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    rnd = random.Random(1)
    vocabulary = words(rnd, 60)
    texts = []
    for _ in range(20):
        order = rnd.sample(vocabulary, 60)
        texts += [order, order + order[:6]]
    assert components(spark, texts) == {i: i - i % 2 for i in range(40)}


def test_chain(spark):
    """Each text is similar to the next only, so no centre is similar to all."""
    rnd = random.Random(2)
    line = words(rnd, 200)
    assert set(components(spark, [line[i * 10 : i * 10 + 100] for i in range(10)]).values()) == {0}


def test_every_shape_of_edit(spark):
    rnd = random.Random(3)
    edits = [
        (100, lambda t: t + words(rnd, 20)),
        (120, lambda t: t[:-20]),
        (200, lambda t: t[:50] + words(rnd, 40) + t[50:]),
        (300, lambda t: t[:100] + words(rnd, 25) + t[125:]),
        (20, lambda t: t + words(rnd, 3)),
        (9, lambda t: t + words(rnd, 1)),
    ]
    texts = []
    for n, edit in edits:
        for _ in range(15):
            t = words(rnd, n)
            texts += [t, edit(t)]
    assert all(neardup.similarity(" ".join(x).encode(), " ".join(y).encode(), 5) >= 0.8 for x, y in zip(texts[::2], texts[1::2], strict=True))
    assert components(spark, texts) == {i: i - i % 2 for i in range(len(texts))}
