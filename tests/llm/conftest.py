import random

import pytest

WORDS = "the of and to in theand ofin toin the, of. And Thein é日本 naïve don't x1y2 ﬁn ΣΑΣ ... !!! a\u0301".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of all kinds: none, empty, blank, long, of one word, with odd white space, marks, copies and near copies."""
    rnd = random.Random(3)
    base = sentence(rnd, 120)
    long = sentence(rnd, 30_000)
    texts = [None, "", " ", "\n\t ", "word", "two words", "▁▁x ▁", "a\r\nb\r;\x0b\x1c\x85c", "😀 x😀", "\x00a b", "x" * 5000, "<s></s><unk><|endoftext|>", "IT'S 's ''", long, long]
    texts += [base, base, base.upper(), base.replace("the", "thee", 1), base + " extra"] * 2
    return texts + [sentence(rnd, rnd.randrange(1, 80)) for _ in range(60)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Rows with repeated and null ids, null columns, and columns whose names clash with what operators add."""
    rows = [(None if i == 7 else i - (i == 9), t, None if i % 11 == 5 else ["en", "fr"][i % 2], None if i % 5 == 0 else f"src{i % 3}", i, 0.5, "x", "x") for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, score double, id string, h string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
