"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

A sequence of tokens is what a chunk encodes to if and only if each neighbouring pair is what the pair's own bytes
encode to. So the encoding of a prefix is that of a shorter prefix and one more token that fits its last one, and
exactly one token does: a chunk is encoded by storing, for each byte, the last token of the prefix that ends there,
and read back from its end. What is stored answers more than the ids: to append bytes, the table goes on where it
ends; after an edit, prefixes before it keep their tokens, and chunks behind it theirs as soon as the text's
chunk borders are those from before. Chunks are the matches of the vocabulary's pattern, each encoded on its own.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.chunks import ChunkTable, shared_table
from rasterloom.llm.common import grouped

#: Entries of the memory of pairs that fit or don't.
PAIRS = 400_000
#: Characters behind a match that can decide where it ends; the patterns known here look two ahead, at a
#: contraction's letters.
AHEAD = 2


class ByteVocabulary:
    """Ranks of byte strings, and the encoding of single chunks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.size_of = {i: len(t) for t, i in self.ranks.items()}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte has no token in this vocabulary")
        if any(len(t) > 1 and self.merged(t) != [i] for t, i in self.ranks.items()):
            raise ValueError("this vocabulary has a token that its own merges don't make")
        #: All ends of tokens: the token's number, or -1 for those that are none.
        self.tails = {t[k:]: -1 for t in self.ranks for k in range(1, len(t))} | self.ranks
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """By the rule itself: of all neighbours the pair of the lowest rank is joined, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
            k = found.index(least := min(found))
            if least == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether both tokens' bytes together encode to these two."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            both = self.bytes_of[left] + self.bytes_of[right]
            found = self.pairs[key] = both not in self.ranks and self.merged(both) == [left, right]
        return found

    def extend(self, chunk: bytes, last: list[int]) -> None:
        """`last` holds the last token of each prefix of the chunk as far as it goes; afterwards of all of them."""
        tails, fits = self.tails, self.fits
        for end in range(len(last) + 1, len(chunk) + 1):
            found = []
            for start in range(end - 1, -1, -1):
                token = tails.get(chunk[start:end])
                if token is None:
                    break
                if token >= 0:
                    found.append((start, token))
            for start, token in reversed(found):
                if not start or fits(last[start - 1], token):
                    last.append(token)
                    break
            else:
                raise AssertionError("no token ends a prefix")  # can't be: the encoding of the prefix has a last token

    def ids(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(token := last[end - 1])
            end -= self.size_of[token]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encoded(self, chunks: list[str]) -> list[tuple[str, bytes, bytes]]:
        """For each chunk: its ids as text, what they decode to, and its prefixes' last tokens (int32). In order of
        text, a chunk goes on from the longest prefix that it shares with the one before."""
        out: list[tuple] = [()] * len(chunks)
        data = [c.encode() for c in chunks]
        last, previous = [], b""
        for k in sorted(range(len(data)), key=data.__getitem__):
            chunk, shared = data[k], 0
            most = min(len(chunk), len(previous))
            while shared < most and chunk[shared] == previous[shared]:
                shared += 1
            del last[shared:]
            self.extend(chunk, last)
            ids, previous = self.ids(last), chunk
            out[k] = "".join(f"{i}," for i in ids), self.decode(ids), array("i", last).tobytes()
        return out


_vocabularies: dict[str, ByteVocabulary] = {}


def vocabulary(path: str) -> ByteVocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = ByteVocabulary(path)
    return _vocabularies[path]


def _table(path: str) -> ChunkTable:
    return shared_table(("byte tokens", path), lambda: ChunkTable(vocabulary(path).encoded, 3))


def _marked(parts: list[bytes]) -> np.ndarray:
    """Last tokens of a text's chunks in one array, complemented where a chunk ends."""
    out = np.frombuffer(b"".join(parts), np.int32).copy()
    ends = np.cumsum([len(p) // 4 for p in parts], dtype=np.int64) - 1
    out[ends] = ~out[ends]
    return out


class PrefixTokens:
    """A text with its prefixes' last tokens: int32 for each byte, complemented at the last byte of a chunk."""

    def __init__(self, path: str, pattern: str, text: str = "", last: bytes | None = None):
        """last: as stored; else the text is encoded."""
        self.path, self.pattern, self.text = path, pattern, text
        if last is None:
            chunks = regex.findall(pattern, text)
            table = _table(path)
            table.learn([chunks])
            self.last = _marked(list(map(table.column(2), chunks)))
        else:
            self.last = np.frombuffer(last, np.int32)

    def ids(self) -> list[int]:
        v, out, start = vocabulary(self.path), [], 0
        for end in (np.flatnonzero(self.last < 0) + 1).tolist():
            part = self.last[start:end].tolist()
            part[-1] = ~part[-1]
            out += v.ids(part)
            start = end
        return out

    def append(self, text: str) -> PrefixTokens:
        return self.edit(len(self.text), 0, text)

    def edit(self, at: int, removed: int, inserted: str) -> PrefixTokens:
        """The text with `inserted` in place of `removed` characters from `at`; `reworked` tells how many bytes got
        new last tokens, the others kept theirs."""
        at = max(0, min(at, len(self.text)))
        removed = max(0, min(removed, len(self.text) - at))
        size = lambda s: len(s.encode())
        old_ends = np.flatnonzero(self.last < 0) + 1
        here, gone, new = size(self.text[:at]), size(self.text[at : at + removed]), size(inserted)
        # matches that end so far before the edit that it can't be seen from there
        sure = np.searchsorted(old_ends, size(self.text[: max(0, at - AHEAD)]), "right")
        begin = int(old_ends[sure - 1]) if sure else 0
        text = self.text[:at] + inserted + self.text[at + removed :]
        v, parts, place, kept = vocabulary(self.path), [], begin, len(self.last)
        reworked = 0
        starts = {0, *old_ends.tolist()}
        for m in regex.compile(self.pattern).finditer(text, len(self.text[:at].encode()[:begin].decode())):
            if place >= here + new and place - new + gone in starts:
                kept = place - new + gone  # from here on the borders are the old ones
                break
            chunk, last = m[0].encode(), []
            if place == begin:  # the first chunk starts where an old one did
                known = int(old_ends[sure]) if sure < len(old_ends) else len(self.last)
                last = self.last[place : min(here, known, place + len(chunk))].tolist()
                if last and last[-1] < 0:
                    last[-1] = ~last[-1]
            reworked += len(chunk) - len(last)
            v.extend(chunk, last)
            parts.append(array("i", last).tobytes())
            place += len(chunk)
        out = PrefixTokens(self.path, self.pattern, text, np.concatenate([self.last[:begin], _marked(parts), self.last[kept:]]).astype(np.int32).tobytes())
        out.reworked = reworked
        return out


def byte_token_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """A row for each row of docs: the id, n_tokens, and SHA-256 of the ids and of the bytes that they decode to.

    full adds ids (array of int), decoded (string) and last (binary: see PrefixTokens). A null text counts as empty,
    and an empty text has no ids. Strings of special tokens are ordinary text. Rows with equal or null ids are kept as
    they are; other columns of docs are not carried. Whole texts count, however long; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = _table(path), regex.compile(pattern).findall
        for batch in batches:
            out: list[tuple] = []
            for _, texts in grouped(batch.column(1)):
                lists = [split(x.decode(errors="replace")) if x else [] for x in texts]
                table.learn(lists)
                csv_of, decoded_of, last_of = (table.column(k) for k in range(3))
                for chunks in lists:
                    ids = "".join(map(csv_of, chunks))
                    back = b"".join(map(decoded_of, chunks))
                    row = (ids.count(","), hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                    out.append(row + ([int(i) for i in ids[:-1].split(",")] if ids else [], back.decode(errors="replace"), _marked(list(map(last_of, chunks))).tobytes()) if full else row)
            kinds = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("last", pa.binary()))[: 6 if full else 3]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], ["id", *(n for n, _ in kinds)])

    extra = ", ids array<int>, decoded string, last binary" if full else ""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("id", id_col)


def edited_tokens(stored: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Texts with an edit each, encoded from what is stored of them: rows (id, text, last, at, removed, inserted) give
    (id, text, last, n_tokens, ids, reworked), where reworked counts the bytes whose tokens were worked out anew.

    An edit at the end appends. Places beyond the text count as its end; nulls count as an empty text, as nothing
    stored, as the start, as nothing removed or inserted. Rows with equal or null ids are kept; other columns are not
    carried; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, last, at, removed, inserted in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                t = PrefixTokens(path, pattern, text or "", last if text else None).edit(at or 0, removed or 0, inserted or "")
                ids = t.ids()
                out.append((t.text, t.last.tobytes(), len(ids), ids, t.reworked))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (("text", pa.string()), ("last", pa.binary()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("reworked", pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], ["id", *(n for n, _ in kinds)])

    rows = stored.select(F.col(id_col).cast("long").alias("id"), "text", "last", F.col("at").cast("int"), F.col("removed").cast("int"), "inserted")
    return rows.mapInArrow(run, "id long, text string, last binary, n_tokens long, ids array<int>, reworked long").withColumnRenamed("id", id_col)
