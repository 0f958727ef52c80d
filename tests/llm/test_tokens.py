"""Token operators against the libraries on whole texts."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rasterloom.llm import chunks, packing, sentencepieces, tokencounts

PIECES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_round_trip(odd_docs, odd_texts, no_docs, library):
    found = sentencepieces.sentencepiece_round_trip(odd_docs, PIECES, full=True).collect()
    want = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        back = library.decode(ids)
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tuple(ids), back] += 1
    assert Counter((*r[:4], tuple(r[4]), r[5]) for r in found) == want
    assert sentencepieces.sentencepiece_round_trip(no_docs, PIECES).collect() == []


def test_prefix_counts(odd_docs, odd_texts, no_docs, library):
    for text in odd_texts:
        counts = tokencounts.prefix_counts(PIECES, text)
        ends = range(len(text or "") + 1) if len(text or "") < 700 else [0, 1, 17, len(text) // 2, len(text)]
        assert [counts[k] for k in ends] == [len(library.encode((text or "")[:k])) for k in ends]
    found = tokencounts.token_counts(odd_docs, PIECES, 50, full=True).collect()
    assert Counter(r[:4] for r in found) == Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 50) for r in odd_docs.collect())
    by_id = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"] not in (None, 8)}
    for r in found:
        if r["doc_id"] in by_id and len(by_id[r["doc_id"]]) < 700:
            text = by_id[r["doc_id"]]
            assert r["fit_chars"] == max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 50)
    assert tokencounts.token_counts(no_docs, PIECES).collect() == []


def test_table_starts_afresh():
    table = chunks.ChunkTable(lambda cs: [(c * 2,) for c in cs], 1, limit=500)
    for i in range(50):
        mine = [b"%d" % (i * k) for k in range(20)]
        table.learn([mine])
        assert list(map(table.column(0), mine)) == [c * 2 for c in mine]
    assert len(table.columns[0]) < 50


def test_packing(odd_docs, no_docs):
    found = packing.best_fit_packing(odd_docs, WORDS, 64, full=True).collect()
    model = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((*r[:5], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in found) == want
    sequences: dict = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r["length"] for r in found) // 64) + 1
    assert packing.best_fit_packing(no_docs, WORDS, 64).collect() == []


@pytest.mark.parametrize("histogram", [{64: 5}, {33: 10}, {1: 1}, {40: 7, 24: 3, 12: 9, 2: 100}, {i: 3 for i in range(1, 65)}, {}])
def test_plan(histogram):
    slots = packing.plan(histogram, 64)
    used, rooms = Counter(), {}
    for length, first, n, times, sequence, offset in slots.tolist():
        for rank in range(first, first + n):
            assert (length, rank) not in used
            used[length, rank] += 1
            k, inside = divmod(rank - first, times)
            rooms.setdefault(sequence + k, []).append((offset + inside * length, length))
    assert used == Counter((v, k) for v, n in histogram.items() for k in range(n))
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
