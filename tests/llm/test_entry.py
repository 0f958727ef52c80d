"""The registered queries over a whole small table, against the libraries and plain versions of each contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rasterloom.llm import entry, packing
from tests.llm.test_duplicates import roots, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").set_index("doc_id").text.fillna("")


def rows(spark, query):
    found = {r["doc_id"]: r for r in query(spark, FOLDER).collect()}
    return found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_and_op9(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    one, nine = rows(spark, entry.op1_sentencepiece), rows(spark, entry.op9_tokencounts)
    assert set(one) == set(nine) == set(docs.index)
    for i, text in docs.items():
        ids = model.encode(text)
        assert (one[i]["n_tokens"], one[i]["ids_sha256"], one[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
        assert (nine[i]["n_bytes"], nine[i]["n_tokens"], nine[i]["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 4096)


def test_op2(spark, docs):
    found, ids = rows(spark, entry.op2_simhash), list(docs.index)
    fps = [slow_fingerprint(t) for t in docs]
    group = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in set(group)}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {i: (f"{f:016x}", least[g]) for i, f, g in zip(ids, fps, group, strict=True)}


def test_op4(spark, docs):
    found = entry.op4_packing(spark, FOLDER).toPandas()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in docs.items():
        ids = [*model.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[i, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found.itertuples()} == want
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048
    assert found.sequence_id.nunique() <= math.ceil(found.length.sum() / 2048) * 1.02 + 1


def slow_best_fit(lengths, capacity):
    """Each piece, the longest first, into the fullest sequence that has room."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((capacity if fit is None else fit) - n)
    return len(room)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_plans_need_no_more_sequences_than_a_slow_packer(capacity):
    rng = np.random.default_rng(capacity)
    for lengths in (rng.integers(1, capacity + 1, 3000), np.minimum(capacity, rng.geometric(6 / capacity, 3000)), np.full(500, capacity // 3)):
        slots = packing.plan(Counter(lengths.tolist()), capacity)
        placed = Counter()
        for length, _, n, *_ in slots:
            placed[length] += n
        assert placed == Counter(lengths.tolist())
        used = int((slots[:, 4] + slots[:, 2] // slots[:, 3]).max())
        assert used <= slow_best_fit(lengths.tolist(), capacity) * 1.01 + 1


def test_op7(spark, docs):
    found = rows(spark, entry.op7_lm)
    split = {i: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\n"] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in split}
    counts = Counter(w for i, t in split.items() if not held[i] for w in t)
    total = sum(counts.values())
    assert set(found) == set(split)
    for i, t in split.items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t), rel_tol=1e-9)
    assert sum(r["score"] for r in found.values() if r["held_out"]) > sum(r["base_score"] for r in found.values() if r["held_out"])


def test_op8(spark, docs):
    found = rows(spark, entry.op8_media)
    assert set(found) == set(docs.index)
    for i, text in docs.items():
        data = text.encode()
        payload = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
