"""Byte-level tokens against the library, on whole texts, after edits, and on characters of all kinds."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rasterloom.llm import bytetokens, entry

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["a", "b", " ", "  ", "'", "l", "ll", "s", "'re", "\n", "é", "日本", "1", "22", "!", "?!", "the", " the", "tion", "́", "👍🏽", "\x85", "'v", "e"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytetokens.vocabulary(PATH).ranks, special_tokens={})


def digests(ids, library):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_op13(spark, small, library):
    found = {r["doc_id"]: tuple(r)[1:] for r in entry.op13_bytetokens(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert found == {r["doc_id"]: digests(library.encode_ordinary(r["text"] or ""), library) for r in docs}


def test_odd_rows(odd_docs, no_docs, library):
    found = bytetokens.byte_token_round_trip(odd_docs, PATH, PATTERN, full=True).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], *digests(ids, library), tuple(ids), r["text"] or "")] += 1
    assert Counter((*r[:4], tuple(r["ids"]), r["decoded"]) for r in found) == want
    assert bytetokens.byte_token_round_trip(no_docs, PATH, PATTERN).collect() == []


def test_every_prefix_has_one_last_token(library):
    v = bytetokens.vocabulary(PATH)
    for chunk in (" naturally", "aaaaaaaaaaaaaaaaaaaaaa", "日本語日本語", " Donaudampfschifffahrtsgesellschaft", "́́é", "!!!!!??!?!!"):
        data, last = chunk.encode(), []
        v.extend(data, last)
        for end in range(1, len(data) + 1):
            ids = v.merged(data[:end])
            fitting = [t for k in range(end) if (t := v.ranks.get(data[k:end])) is not None and (not k or v.fits(last[k - 1], t))]
            assert ids[-1] == last[end - 1] and fitting == [last[end - 1]] and v.ids(last[:end]) == ids


def test_edits(library):
    """After each edit the stored tokens are those of the text encoded afresh."""
    rnd = random.Random(1)
    for _ in range(1200):
        text = bytetokens.PrefixTokens(PATH, PATTERN, "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))))
        for _ in range(3):
            at, removed = rnd.choice([len(text.text), rnd.randrange(len(text.text) + 1)]), rnd.choice([0, 0, 1, 2, 5])
            inserted = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(4)))
            after = text.edit(at, removed, inserted)
            assert after.text == text.text[:at] + inserted + text.text[at + removed :]
            assert after.ids() == library.encode_ordinary(after.text)
            assert np.array_equal(after.last, bytetokens.PrefixTokens(PATH, PATTERN, after.text).last)
            text = after


def test_edits_are_local(spark, library):
    words = " ".join(random.Random(2).choice(["the", "nation", "naïve", "1234", "isn't"]) for _ in range(20_000))
    text = bytetokens.PrefixTokens(PATH, PATTERN, words)
    for at, removed, inserted in ((50_000, 3, "xyz"), (len(words), 0, "ly and more"), (0, 1, "T"), (70_000, 0, " ")):
        after = text.edit(at, removed, inserted)
        assert after.ids() == library.encode_ordinary(after.text) and after.reworked < 60
    docs = spark.createDataFrame([(1, words, 5, 2, "?"), (1, "", 0, 0, "new"), (None, None, None, None, None), (4, "short", 99, 9, "er")], "doc_id long, text string, at int, removed int, inserted string")
    stored = bytetokens.byte_token_round_trip(docs, PATH, PATTERN, full=True).selectExpr("doc_id AS i", "decoded", "last")
    both = docs.join(stored, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("decoded") == F.coalesce("text", F.lit(""))), "left")
    found = bytetokens.edited_tokens(both, PATH, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == sorted([(0, ""), (1, "new"), (1, words[:5] + "?" + words[7:]), (4, "shorter")])
    assert all(r["ids"] == library.encode_ordinary(r["text"]) and len(r["ids"]) == r["n_tokens"] for r in found)
    assert bytetokens.edited_tokens(both.limit(0), PATH, PATTERN).collect() == []


def test_characters_fall_in_the_same_classes(library):
    characters = [chr(i) for i in range(0, 0x110000, 11) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(characters), 64):
        text = "".join(f"a{c}1{c}!{c} " for c in characters[k : k + 64])
        assert bytetokens.PrefixTokens(PATH, PATTERN, text).ids() == library.encode_ordinary(text)


def test_other_vocabularies(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bytetokens.ByteVocabulary(str(tmp_path / "few"))
    import base64

    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)] + [base64.b64encode(b"abc") + b" 256"]
    (tmp_path / "orphan").write_bytes(b"\n".join(lines))
    with pytest.raises(ValueError):
        bytetokens.ByteVocabulary(str(tmp_path / "orphan"))
