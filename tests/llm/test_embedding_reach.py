import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import embeddings


def brute(rows):
    unit = np.array([r / np.linalg.norm(r) for r in rows])
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    return near.sum(1).tolist()


def links(spark, rows, **options):
    docs = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    return {r["vec_id"]: r["n_links"] for r in embeddings.embedding_components(docs, **options).collect()}


def test_default_reach_counts_every_link(spark, monkeypatch):
    """A third of the vectors in one drifting group, cut by many cells' borders: n_links of both ends, as by brute force."""
    monkeypatch.setattr(embeddings, "CELL", 0.01)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    drift = rng.normal(size=16)
    rows = [centre + drift * i / 100 + rng.normal(size=16) * 0.06 for i in range(100)] + [rng.normal(size=16) for _ in range(200)]
    found, want = links(spark, rows), brute(rows)
    assert sum(want) > 100
    assert found == dict(enumerate(want))


@pytest.mark.parametrize("dim", [2, 4, 8, 64])
def test_recall(spark, dim):
    """Random unit vectors, each with a partner at a cosine of 0.98 to 0.99."""
    rng = np.random.default_rng(dim)
    one = rng.normal(size=(800, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    away = rng.normal(size=one.shape)
    away -= (away * one).sum(1, keepdims=True) * one
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.98, 0.99, (800, 1)))
    rows = np.concatenate([one, one * np.cos(angle) + away * np.sin(angle)])
    found, want = links(spark, rows), brute(rows)
    assert found == dict(enumerate(want))


def test_a_hot_label(spark):
    """50,000 vectors of one label, some thousands of them linked: every link of all that have an id divisible by 100,
    and of all linked ones, against brute force."""
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(50_000, 16))
    centres = rng.integers(0, 40_000, 6000)
    rows[44_000:] = rows[centres] + rng.normal(size=(6000, 16)) * 0.17
    docs = spark.createDataFrame(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows)), "label": np.ones(len(rows), int)}))
    found = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_components(docs).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    asked = np.union1d(np.arange(0, len(rows), 100), np.arange(44_000, len(rows)))
    want = np.concatenate([(unit[part] @ unit.T >= 0.98).sum(1) - 1 for part in np.array_split(asked, 20)])
    assert want.sum() > 2000 and [found[i] for i in asked.tolist()] == want.tolist()


def near_pairs(rng, n, dim, cosines):
    """n random unit vectors, and a partner of each at a cosine out of this range."""
    one = rng.normal(size=(n, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    away = rng.normal(size=one.shape)
    away -= (away * one).sum(1, keepdims=True) * one
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(*cosines, (n, 1)))
    return np.concatenate([one, one * np.cos(angle) + away * np.sin(angle)])


def test_moves_as_much_as_it_reads(spark):
    """What is shuffled grows with the vectors, not with the cells that they look into."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        found = store.executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    moved = []
    for n in (2500, 10_000):
        rows = np.random.default_rng(n).normal(size=(n, 64))
        docs = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(rows)), "label": np.arange(n) % 10}))
        before = shuffled()
        assert embeddings.embedding_components(docs).where("n_links = 0 AND kept").count() == n
        moved.append(shuffled() - before)
    assert moved[1] < 4.5 * moved[0] and moved[1] < 3 * 10_000 * 64 * 8


@pytest.mark.parametrize("dim", [2, 64])
def test_blocks_of_a_label(spark, monkeypatch, dim):
    """A label of many blocks: every link within and between them; blocks out of reach aren't visited."""
    monkeypatch.setattr(embeddings, "BLOCK", 150)
    monkeypatch.setattr(embeddings, "CELL", 4)
    dealt, keep = [], embeddings._links
    monkeypatch.setattr(embeddings, "_links", lambda rows, *a: dealt.append(rows.count()) or keep(rows, *a))
    rows = near_pairs(np.random.default_rng(dim), 600, dim, (0.98, 0.99))
    assert links(spark, rows) == dict(enumerate(brute(rows)))
    assert dealt[0] <= (4 if dim == 2 else 9) * len(rows)


def test_cosines_at_the_threshold(spark):
    """Single precision can't tell them."""
    rng = np.random.default_rng(3)
    rows = np.concatenate([near_pairs(rng, 100, 64, (c, c)) for c in (0.98 + 1e-12, 0.98 - 1e-12, 0.98 + 1e-8, 0.98 - 1e-8)])
    found = links(spark, rows)
    assert [sum(found[i] for i in range(at, at + 200)) for at in range(0, 800, 200)] == [200, 0, 200, 0]


def test_one_number(spark):
    rows = [np.array([x]) for x in (1.0, 2.0, -1.0, 3.0)]
    assert links(spark, rows) == {0: 2, 1: 2, 2: 0, 3: 2}


def test_a_group_of_thousands(spark):
    """All linked with each other, of several strips, besides vectors with none."""
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.normal(size=64) + rng.normal(size=(3000, 64)) * 0.05, rng.normal(size=(500, 64))])
    docs = spark.createDataFrame([(9000 - i, r.tolist(), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {9000 - r["vec_id"]: r for r in embeddings.embedding_components(docs).collect()}
    assert all(found[i]["n_links"] == 2999 and found[i]["component_id"] == 6001 for i in range(3000))
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(3000, 3500))


def test_stars():
    rng = np.random.default_rng(6)
    u, v = rng.integers(0, 500, (2, 350)) * 7
    want = {int(x): int(x) for x in np.union1d(u, v)}
    for _ in want:
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            want[a] = want[b] = min(want[a], want[b])
    found = dict(zip(*(x.tolist() for x in embeddings._stars(u, v)), strict=True))
    assert found == {a: b for a, b in want.items() if a != b}
