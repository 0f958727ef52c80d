"""SentencePiece encoding and decoding by a table of distinct chunks.

With an identity normaliser, white space is marked as U+2581 and no piece of the vocabulary crosses from another
character to a mark, or holds a line feed. A chunk, a run of marks with what follows it or a line feed, is
therefore segmented alike wherever it stands: the library encodes and decodes each distinct chunk once, and the
ids of a text are the ids of its chunks in order. `Pieces` checks both properties of the model and refuses others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.chunks import ChunkTable, shared_table
from rasterloom.llm.common import grouped

MARK = "▁"
_CHUNK = re.compile(rb" +[^ \n]*|\n|[^ \n]+")


class Pieces:
    """A model and how it segments chunks."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m = self.model
        #: A line feed before a chunk keeps the library's leading mark away from it.
        self.lead = m.encode("\n")
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross chunk borders")
        if m.encode(" ﬁ  á ") != m.encode(" ﬁ") + m.encode("\n  á")[len(self.lead) :] + m.encode("\n ")[len(self.lead) :]:
            raise ValueError("this model doesn't keep white space and characters as they are")

    def chunks(self, text: bytes) -> list[bytes]:
        """Marks are spaces here; the library marks the start of a text that isn't empty."""
        return _CHUNK.findall(b" " + text.replace(MARK.encode(), b" ")) if text else []

    def ids(self, chunks: list[bytes]) -> list[list[int]]:
        k = len(self.lead)
        return [x[k:] for x in self.model.encode(["\n" + c.decode() for c in chunks], num_threads=1)]

    def decoded(self, ids: list[list[int]]) -> list[bytes]:
        return [x[1:].encode() for x in self.model.decode([self.lead + x for x in ids], num_threads=1)]


_pieces: dict[str, Pieces] = {}


def pieces(model_path: str) -> Pieces:
    if model_path not in _pieces:
        _pieces[model_path] = Pieces(model_path)
    return _pieces[model_path]


def _table(model_path: str) -> ChunkTable:
    model = pieces(model_path)

    def work(chunks: list[bytes]) -> list[tuple]:
        ids = model.ids(chunks)
        return [("".join(f"{i}," for i in x), d) for x, d in zip(ids, model.decoded(ids), strict=True)]

    return shared_table(("sentencepiece", model_path), lambda: ChunkTable(work, 2))


def sentencepiece_round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """A row for each row of docs: the id, n_tokens, and SHA-256 of the ids and of what they decode to.

    full adds ids (array of int) and decoded (string). A null text counts as empty; an empty text has no ids.
    Rows with equal or null ids are kept as they are; other columns of docs are not carried. Whole texts count,
    however long; an empty table gives no rows.
    """
    extra = ", ids array<int>, decoded string" if full else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = pieces(model_path), _table(model_path)
        for batch in batches:
            out: list[tuple] = []
            for _, texts in grouped(batch.column(1)):
                lists = [model.chunks(x) if x else [] for x in texts]
                table.learn(lists)
                csv_of, decoded_of = table.column(0), table.column(1)
                for chunks in lists:
                    ids = "".join(map(csv_of, chunks))
                    back = b"".join(map(decoded_of, chunks))[1:]  # decoding drops the mark that encoding added
                    row = (ids.count(","), hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                    out.append(row + ([int(i) for i in ids[:-1].split(",")] if ids else [], back.decode()) if full else row)
            columns = list(zip(*out, strict=True)) or [[]] * (5 if full else 3)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("id", id_col)
