"""Models against their definition, and by held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from rasterloom.llm import entry, features, language, lm, quality
from rasterloom.llm.common import table


def test_ngram_counts(monkeypatch):
    text = "héllo wörld ".encode() * 50
    whole = features.ngram_counts(text, (1, 2, 4), 10)
    monkeypatch.setattr(features, "STRIDE", 37)
    assert (features.ngram_counts(text, (1, 2, 4), 10) == whole).all()
    assert whole.sum() == sum(len(text) + 2 - n + 1 for n in (1, 2, 4)) and features.ngram_counts(b"", (3,), 4).sum() == 0


def test_language(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    found = entry.op3_language(spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/documents.parquet"), on="doc_id")
    assert len(found) == 1000 and (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert (found.lang_pred == found.lang)[found.held_out].mean() > 0.98 and found.score.between(0, 1).all()
    model = language.fit_language(odd_docs.selectExpr("doc_id AS id", "text", "lang AS label"))
    got = language.identify_language(odd_docs, model, keep=True).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        und = r["text"] is None or not re.search(r"[^\W\d_]", r["text"])
        assert (r["lang_pred"] == "und") == und and (not und or r["rejected"])
    assert language.fit_language(no_docs.selectExpr("doc_id AS id", "text", "lang AS label")) is None
    assert {r["lang_pred"] for r in language.identify_language(odd_docs, None).collect()} == {"und"}
    assert language.identify_language(no_docs, model).collect() == []


def test_quality(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    found = entry.op6_quality(spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id", how="left")
    assert len(found) == 1000 and (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    held = found[found.held_out & found.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.95 and ((found.score >= 0.3) == (found.predicted == 1)).all()
    voters = quality.fit_voters(odd_docs.selectExpr("doc_id AS id", "text", "CASE WHEN doc_id % 7 = 0 THEN null ELSE cast(doc_id % 2 AS int) END AS label"), 20)
    assert 0 < len(voters.labels) <= 20
    got = quality.quality_scores(odd_docs, voters, keep=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_tokens", "id", "h", "score", "predicted"] and got.count() == odd_docs.count()
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = quality.fit_voters(no_docs.selectExpr("doc_id AS id", "text", "1 AS label"))
    assert {r["score"] for r in quality.quality_scores(odd_docs, none).collect()} == {0.5}
    assert quality.quality_scores(no_docs, voters).collect() == []


def slow_lm(texts, learn):
    split = [[*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for t in texts]
    one = Counter(w for t, k in zip(split, learn, strict=True) if k for w in t)
    two = Counter(p for t, k in zip(split, learn, strict=True) if k for p in zip(t, t[1:], strict=False))
    total, distinct = sum(one.values()), len(one)
    once, twice = (sum(v == k for v in one.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))

    def p(w):
        return ((one[w] - discount) / total if one[w] else (discount * distinct + 1e-9) / total) if total else 1.0

    out = []
    for t in split:
        score = math.log10(p(t[0]))
        for h, w in zip(t, t[1:], strict=False):
            share = lm.SHARE * one[h] / (one[h] + lm.DOUBT)
            score += math.log10((share * two[h, w] / one[h] if one[h] else 0) + (1 - share) * p(w))
        out.append((len(t), sum(one[w] > 0 for w in t), total, sum(math.log10((one[w] + 1) / (total + distinct + 1)) for w in t), score))
    return out, (one, two, p)


@pytest.mark.parametrize(("block", "ranges"), [(2000, 10**9), (10**9, 10**9), (50_000, 9000)])
@pytest.mark.parametrize("rule", ["doc_id % 3 = 0", "true"])
def test_lm(odd_docs, no_docs, block, ranges, rule):
    """In small blocks and in one, and with more ranges of hashes than shuffle partitions."""
    rows = odd_docs.select("doc_id", "text").collect()
    learn = [rule != "true" and not (r["doc_id"] is not None and r["doc_id"] % 3 == 0) for r in rows]
    want, _ = slow_lm([r["text"] for r in rows], learn)
    found = sorted(lm.lm_scores(odd_docs, rule, block_bytes=block, range_bytes=ranges).collect(), key=lambda r: (str(r[0]), r["n_tokens"], r["score"]))
    want = sorted(((r["doc_id"], not k, *w) for r, k, w in zip(rows, learn, want, strict=True)), key=lambda r: (str(r[0]), r[2], r[6]))
    for a, b in zip(found, want, strict=True):
        assert tuple(a[:5]) == tuple(b[:5])
        assert abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6 * max(1, abs(b[6]))
    assert lm.lm_scores(no_docs, rule).collect() == []


def test_lm_sums_to_one_and_beats_the_base(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").toPandas()
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in docs.doc_id]
    scores, (one, two, p) = slow_lm(list(docs.text), learn)
    unseen = p("never seen")
    assert abs(sum(map(p, one)) + unseen - 1) < 1e-9
    follow: dict = {}
    for (h, w), n in two.items():
        follow.setdefault(h, {})[w] = n
    for h in list(follow)[:20]:
        share = lm.SHARE * one[h] / (one[h] + lm.DOUBT)
        assert abs(sum(share * follow[h].get(w, 0) / one[h] + (1 - share) * p(w) for w in one) + (1 - share) * unseen - 1) < 1e-9
    assert sum(s[4] for s, k in zip(scores, learn, strict=True) if not k) > sum(s[3] for s, k in zip(scores, learn, strict=True) if not k)


def test_packed_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        hashes = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lm.unpack(lm.pack(hashes)) == hashes).all() and len(lm.unpack(lm.pack(hashes))) == n
        counts = rng.integers(0, 400, n)
        assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()
    near = np.arange(1000, dtype=np.uint64) * np.uint64(1 << 40) + np.uint64(1 << 63)
    assert lm.pack(near)[:1] == b"6" and (lm.unpack(lm.pack(near)) == near).all()


def test_requests_grow_with_the_text_and_blocks_stay_even(spark):
    """A block asks each range once, however many blocks there are; one id and one length spread over all blocks."""
    texts = [f"a b c{i:05d}".encode() for i in range(600)]
    for n in (1, 2, 4):
        rows = sum(len(lm._request(k, texts[k::n], np.zeros(len(texts[k::n]), bool), 7)) for k in range(n))
        assert rows == 7 * n
    for one in ("cast(7 AS long)", "cast(null AS long)"):
        docs = spark.range(100_000).selectExpr(f"{one} AS id", "cast(concat('word ', lpad(id, 6, '0')) AS binary) AS text")
        sizes = [r["count"] for r in lm._dealt(docs, 20).groupBy("block").count().collect()]
        assert len(sizes) == 20 and max(sizes) < 1.1 * 100_000 / 20
