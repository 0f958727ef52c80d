"""Exact token counts of every prefix of a text, by dynamic programming.

In byte pair encoding, a sequence of tokens is what a text encodes to if and only if each neighbouring pair is what
the pair's own text encodes to. The encoding of a prefix is therefore the encoding of a shorter prefix and one more
token, which fits the last token of the shorter one; at each place, one candidate does. So one pass over a chunk
gives the last token and the count of each of its prefixes. A text's counts are its chunks' counts, summed up; as
steps of one byte a character they answer any question of budget or truncation without encoding again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.chunks import ChunkTable, shared_table
from rasterloom.llm.common import grouped
from rasterloom.llm.sentencepieces import MARK, Pieces, pieces

#: Entries of the memory of pairs that fit or don't.
PAIRS = 600_000


class PrefixCounts:
    def __init__(self, model: Pieces):
        self.model = model
        m = model.model
        normal = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.known = {m.id_to_piece(i) for i in normal}
        #: All ends of pieces; true for those that are pieces.
        self.tails = {p[i:]: False for p in self.known for i in range(len(p))} | dict.fromkeys(self.known, True)
        self.pairs: dict[tuple[str, str], bool] = {}

    def tokens(self, text: str) -> list[str]:
        """Pieces of a marked text by the library."""
        return self.model.model.encode("\n" + text, out_type=str)[len(self.model.lead) :]

    def fits(self, left: str, right: str) -> bool:
        """Whether the pair is what its own text encodes to; of two characters that aren't pieces it always is."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if left and left + right in self.known:
            found = False  # they would be joined
        else:
            want = [x for t in (left, right) for x in ([t] if t in self.known else [f"<0x{b:02X}>" for b in t.encode()])]
            found = self.tokens(left + right) == want
        self.pairs[left, right] = found
        return found

    def steps(self, chunks: list[str]) -> list[list[int]]:
        """For each character of each marked chunk, how the count grows with it. In order of text, a chunk goes on
        from the longest prefix that it shares with the one before."""
        out: list[list[int]] = [[]] * len(chunks)
        tails, pairs = self.tails, self.pairs
        last, count, previous = [""], [0], ""
        for k in sorted(range(len(chunks)), key=chunks.__getitem__):
            chunk, end = chunks[k], 0
            for end, (x, y) in enumerate(zip(chunk, previous, strict=False)):  # noqa: B007
                if x != y:
                    break
            else:
                end = min(len(chunk), len(previous))
            del last[end + 1 :], count[end + 1 :]
            for end in range(end + 1, len(chunk) + 1):
                for start in range(end - 1, -1, -1):
                    kind = tails.get(token := chunk[start:end])
                    if kind is None and start < end - 1:
                        start = -1
                        break
                    if kind is not False and (pairs[pair] if (pair := (last[start], token)) in pairs else self.fits(*pair)):
                        break
                else:
                    start = -1
                if start < 0:  # no token fits the ones before: the library counts this chunk's prefixes
                    whole = [0, *(len(self.tokens(chunk[:i])) for i in range(1, len(chunk) + 1))]
                    out[k] = [b - a for a, b in zip(whole, whole[1:], strict=False)]
                    last, count, previous = [""], [0], ""
                    break
                last.append(token)
                count.append(count[start] + (1 if kind else len(token.encode())))
            else:
                out[k] = [b - a for a, b in zip(count, count[1:], strict=False)]
                previous = chunk
        return out


def _table(model_path: str) -> ChunkTable:
    def make() -> ChunkTable:
        counts = PrefixCounts(pieces(model_path))
        return ChunkTable(lambda chunks: [(array("b", x).tobytes(),) for x in counts.steps([c.decode().replace(" ", MARK) for c in chunks])], 1)

    return shared_table(("prefix counts", model_path), make)


def prefix_counts(model_path: str, text: str | None) -> np.ndarray:
    """Entry i: the tokens of the first i characters, for i of at least 1; entry 0 is zero."""
    model, table = pieces(model_path), _table(model_path)
    chunks = model.chunks((text or "").encode())
    table.learn([chunks])
    return _counts(b"".join(map(table.column(0), chunks)))


def _counts(steps: bytes) -> np.ndarray:
    """The first step belongs to the mark that the library puts before a text, which the empty prefix lacks."""
    total = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    if len(total):
        total[0] = 0
    return total if len(total) else np.zeros(1, np.int64)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """A row for each row of docs: the id, n_bytes, n_tokens, over_limit, and fit_chars: the characters of the
    longest prefix of at most `limit` tokens.

    full adds steps (binary): for the mark before the text and for each character, how the count grows. A null
    text counts as empty, with no bytes and no tokens. Equal or null ids are kept; other columns are not carried.
    Whole texts count, however long; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = pieces(model_path), _table(model_path)
        for batch in batches:
            out: list[tuple] = []
            for _, texts in grouped(batch.column(1)):
                lists = [model.chunks(x) if x else [] for x in texts]
                table.learn(lists)
                steps_of = table.column(0)
                for text, chunks in zip(texts, lists, strict=True):
                    steps = b"".join(map(steps_of, chunks))
                    n = int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))
                    fit = max(0, len(steps) - 1) if n <= limit else int(np.flatnonzero(_counts(steps) <= limit)[-1])
                    out.append((len(text or b""), n, n > limit, fit, steps if full else b""))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64()), ("steps", pa.binary()))[: 5 if full else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=False))], ["id", *(n for n, _ in kinds)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    kinds = "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + (", steps binary" if full else "")
    return rows.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
