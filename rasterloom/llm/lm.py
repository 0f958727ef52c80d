"""Language-model scores by a weighted backoff automaton.

Documents are dealt into blocks. Each block counts its training unigrams and bigrams, packed by the range that their
64-bit hashes fall in; for every range a task adds up the counts of all blocks and answers each block with the totals
of the n-grams that it asked for, as far as the block's own counts aren't the totals. So a block gets the part of the
model that its own documents can meet, exact counts included, and nothing is broadcast. From it the block builds an
automaton: a state for each word as context and one without context, an arc for each bigram that training saw, and
failure arcs to the state without context. All documents of a block walk it from left to right together; a step
follows an arc, or a failure arc and an arc from there, and adds their log-probabilities.

The model: P(w) discounts every count by an absolute discount, and the mass so freed is that of unseen words.
P(w | h) = s c(h w) / c(h) + (1 - s) P(w) with a share s = SHARE c(h) / (c(h) + DOUBT), which an arc weighs for a seen
bigram; for others only the second term is left, so a failure arc weighs 1 - s. The start of a text has no context.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text to a block.
BLOCK_BYTES = 12_000_000
#: Bytes of text to a range of hashes: what all blocks ask of a range is in one task's memory, several times as large.
RANGE_BYTES = 50_000_000
#: Share of the higher order for frequent contexts, and the count at which a context has half of it: of 20 pairs of
#: weights, those under which texts of the test tables that the counts leave out are likeliest.
SHARE, DOUBT = 0.5, 10.0
SEED = 42
#: A token that no text holds, since tokens hold no white space.
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    return [*text.lower().split(), END]


class BlockTokens:
    """Tokens of a block's documents as numbers, in the documents' order."""

    def __init__(self, texts: list[bytes | None]):
        number: dict[bytes, int] = {}
        parts, self.lengths = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = tokens(t or b"")
            self.lengths[i] = len(words)
            new = number.setdefault
            parts.append(np.array([new(w, len(number)) for w in words], np.int32))
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((digest(w, SEED) for w in number), np.uint64, len(number))

    def bigrams(self, within: np.ndarray) -> np.ndarray:
        """Numbers of neighbours in a document, as context * words + word; `within` marks the tokens of the documents asked for."""
        first = np.zeros(len(self.ids), bool)
        first[self.starts] = True
        at = np.flatnonzero(~first & within)
        return self.ids[at - 1].astype(np.int64) * len(self.hashes) + self.ids[at]

    def counted_bigrams(self, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all distinct neighbours, and how often those stand in training documents."""
        learn = np.repeat(~held_out, self.lengths)
        seen, counts = np.unique(self.bigrams(np.ones(len(learn), bool)), return_counts=True)
        other, n = np.unique(self.bigrams(~learn), return_counts=True)
        counts[np.searchsorted(seen, other)] -= n
        return seen, counts

    def bigram_hashes(self, numbers: np.ndarray) -> np.ndarray:
        h, w = self.hashes[numbers // len(self.hashes)], self.hashes[numbers % len(self.hashes)]
        x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x7F4A7C159E3779B9) + (h >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of six bytes, which dense ranges allow; of eight where one is larger."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    if len(steps) > 1 and not (steps[1:] >> np.uint64(48)).any():
        return b"6" + hashes[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"8" + hashes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.frombuffer(data, np.uint64, offset=1)
    n = (len(data) - 9) // 6
    steps = np.zeros((n + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(n, 6)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each; those of 255 and more stand behind all, with their places."""
    large = np.flatnonzero(counts >= 255)
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + np.concatenate([large, counts[large]]).astype(np.int64).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    places, values = np.frombuffer(data, np.int64, offset=8 + n).reshape(2, -1)
    out[places] = values
    return out


def _ranges(hashes: np.ndarray, parts: int) -> list[slice]:
    """Sorted hashes by the part of the 64-bit range that they fall in."""
    edges = np.array([((1 << 64) * i) // parts for i in range(1, parts)], np.uint64)
    at = [0, *np.searchsorted(hashes, edges), len(hashes)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def _request(block: int, texts: list[bytes | None], held_out: np.ndarray, parts: int) -> pd.DataFrame:
    """A row for each part: this block's unigrams (all) and bigrams (all) with their counts in training documents."""
    t = BlockTokens(texts)
    learn = np.repeat(~held_out, t.lengths)
    words = np.bincount(t.ids[learn], minlength=len(t.hashes))
    order = np.argsort(t.hashes)
    h1, c1 = t.hashes[order], words[order]
    seen, c2 = t.counted_bigrams(held_out)
    h2 = t.bigram_hashes(seen)
    order = np.argsort(h2)
    h2, c2 = h2[order], c2[order]
    rows = zip(_ranges(h1, parts), _ranges(h2, parts), strict=True)
    return pd.DataFrame([(k, block, pack(h1[a]), pack_counts(c1[a]), pack(h2[b]), pack_counts(c2[b])) for k, (a, b) in enumerate(rows)], columns=["part", "block", "h1", "c1", "h2", "c2"])


def _totals(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all blocks and the sums of their counts."""
    h = np.concatenate([unpack(x) for x in hashes])
    c = np.concatenate([unpack_counts(x) for x in counts])
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[at], np.add.reduceat(c, at) if len(h) else c


def _answer(part: pd.DataFrame) -> pd.DataFrame:
    """To each block: the totals of its unigrams, those of its bigrams that it doesn't know, and this part's share of the sums over the vocabulary."""
    u, n1 = _totals(list(part.h1), list(part.c1))
    b, n2 = _totals(list(part.h2), list(part.c2))
    sums = np.array([n1.sum(), (n1 > 0).sum(), (n1 == 1).sum(), (n1 == 2).sum()], np.int64).tobytes()
    out = []
    for block, h1, h2, c2 in zip(part.block, part.h1, part.h2, part.c2, strict=True):
        at = np.searchsorted(b, unpack(h2))
        at = at[n2[at] != unpack_counts(c2)]
        out.append((block, b"", pack_counts(n1[np.searchsorted(u, unpack(h1))]), pack(b[at]), pack_counts(n2[at]), sums, part.part.iloc[0]))
    return pd.DataFrame(out, columns=["block", "h1", "c1", "h2", "c2", "sums", "part"])


class Automaton:
    """States 0 to words - 1 are contexts of that word; state `words` has none. Arcs are kept by state * words + word."""

    def __init__(self, counts: np.ndarray, arcs: np.ndarray, arc_counts: np.ndarray, total: int, distinct: int, once: int, twice: int):
        """counts: of each word; arcs: sorted numbers of bigrams; total to twice: sums over the whole vocabulary."""
        self.words = len(counts)
        discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        unseen = (discount * distinct + 1e-9) / max(1, total) if total else 1.0
        self.p = np.where(counts > 0, (counts - discount) / max(1, total), min(1.0, unseen))
        h, w = arcs // max(1, self.words), arcs % max(1, self.words)
        share = SHARE * counts / (counts + DOUBT)
        self.arcs = arcs
        self.arc_weight = np.log10(SHARE * arc_counts / (counts[h] + DOUBT) + (1 - share[h]) * self.p[w])
        self.root_weight = np.log10(self.p)
        self.fail_weight = np.append(np.log10(1 - share), 0.0)

    def scores(self, t: BlockTokens) -> np.ndarray:
        """Sum of log10 probabilities for each document; all documents take their i-th step together, the longest first in order."""
        order = np.argsort(-t.lengths, kind="stable")
        starts, lengths = t.starts[order], t.lengths[order]
        score, state = np.zeros(len(order)), np.full(len(order), self.words, np.int64)
        active = len(order)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths[:active], -step))
            word = t.ids[starts[:active] + step].astype(np.int64)
            add = self.fail_weight[state[:active]] + self.root_weight[word]
            if len(self.arcs):
                key = np.where(state[:active] < self.words, state[:active] * self.words + word, -1)
                at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                add = np.where(self.arcs[at] == key, self.arc_weight[at], add)
            score[:active] += add
            state[:active] = word
        out = np.zeros(len(order))
        out[order] = score
        return out


def _score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    t = BlockTokens(list(docs.text))
    answers = answers.sort_values("part")
    total, distinct, once, twice = (int(x) for x in np.sum([np.frombuffer(x, np.int64) for x in answers.sums], axis=0))
    counts = np.zeros(len(t.hashes), np.int64)
    counts[np.argsort(t.hashes)] = np.concatenate([unpack_counts(x) for x in answers.c1])
    h2 = np.concatenate([unpack(x) for x in answers.h2])
    n2 = np.concatenate([unpack_counts(x) for x in answers.c2])
    seen, times = t.counted_bigrams(docs.held_out.to_numpy(bool))
    hashes = t.bigram_hashes(seen)
    at = np.minimum(np.searchsorted(h2, hashes), max(0, len(h2) - 1))
    if len(h2):
        times = np.where(h2[at] == hashes, n2[at], times)
    score = Automaton(counts, seen[times > 0], times[times > 0], total, distinct, once, twice).scores(t)
    known = np.append(0, np.cumsum(counts[t.ids] > 0))
    base = np.append(0, np.cumsum(np.log10((counts[t.ids] + 1) / (total + distinct + 1))))
    ends = t.starts + t.lengths
    return pd.DataFrame({
        "id": docs.id, "held_out": docs.held_out, "n_tokens": t.lengths, "n_known": known[ends] - known[t.starts], "train_tokens": total,
        "base_score": base[ends] - base[t.starts], "score": score,
    })


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """By id and text: neither one id nor one length fills a block."""
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))


def lm_scores(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a SQL condition; rows where it is true are not learned from (null: they are). A null text counts as
    empty and has the end token alone. Rows with equal or null ids are kept; other columns are not carried. With
    nothing to learn from, every token is unseen and has probability 1. Whole texts count: one longer than block_bytes
    makes its block as large as itself. An empty table gives no rows. Words and bigrams that share a 64-bit hash would
    count as one.

    Every block asks every range of hashes. There are as many ranges as the session has shuffle partitions, and more
    where a range would stand for over range_bytes of text, so a task's memory is bounded at every size; beyond that
    the rows of requests are as many as blocks times ranges, and grow with the square of the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = int(size // block_bytes) + 1
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // range_bytes))
    dealt = _dealt(rows, blocks)

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _request(key[0], list(pdf.text), pdf.held_out.to_numpy(bool), parts)

    packed = "h1 binary, c1 binary, h2 binary, c2 binary"
    asked = dealt.groupBy("block").applyInPandas(ask, f"part int, block int, {packed}")
    answered = asked.groupBy("part").applyInPandas(_answer, f"block int, {packed}, sums binary, part int")
    kinds = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(_score, kinds).withColumnRenamed("id", id_col)
