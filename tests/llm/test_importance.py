"""Importance resampling against a plain version of its contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from rasterloom.llm import entry
from rasterloom.llm.importance import importance_draw


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_draw(docs, target, share=(25, 100), least=20, longest=2, buckets=10_000):
    def features(text):
        w = slow_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out, takes_part = [], []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score])
        if len(slow_words(text)) >= least:
            takes_part.append((-score, i is None, i or 0))
    return out, sorted(takes_part)[: share[0] * len(takes_part) // share[1]]


def check(found, want, drawn):
    assert Counter(tuple(r)[:4] for r in found) == Counter(map(tuple, want))
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn


def test_op11(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want, drawn = slow_draw([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()])
    check(entry.op11_importance(spark, small).collect(), want, drawn)
    assert drawn


@pytest.mark.parametrize("share", [(25, 100), (1, 1), (0, 1), (1, 3)])
@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, odd_docs, share, longest):
    """Null and repeated ids, null texts, rows that are equal throughout, columns that clash, a target with null texts."""
    docs = odd_docs.unionByName(odd_docs).unionByName(odd_docs.where("doc_id % 5 = 1"))
    target = spark.createDataFrame([(None, 1), ("The naïve and IN", 2), ("", 3), ("in the 日本", 4)], "text string, id int")
    want, drawn = slow_draw([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], share, 3, longest, 500)
    check(importance_draw(docs.repartition(5), target, share, 3, buckets=500, longest=longest).collect(), want, drawn)


def test_empty_tables(odd_docs, no_docs):
    assert importance_draw(no_docs, odd_docs).collect() == []
    want, drawn = slow_draw([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [])
    check(importance_draw(odd_docs, no_docs).collect(), want, drawn)


def test_too_many_buckets(odd_docs):
    with pytest.raises(ValueError):
        importance_draw(odd_docs, odd_docs, buckets=70_000)
