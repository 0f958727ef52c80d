"""A bounded table of what has been worked out for distinct chunks of text.

Natural text repeats its words, so a task works out each distinct chunk once and joins the results back by
position. The table belongs to a Python worker and outlives its tasks; when it is full it starts afresh, which
changes the time taken and never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Bytes of chunks and values, with what Python adds to each entry, that a worker's table holds.
TABLE_BYTES = 160_000_000
ENTRY_BYTES = 180


class ChunkTable:
    def __init__(self, work: Callable[[list[bytes]], list[tuple]], width: int, limit: int = TABLE_BYTES):
        """work: distinct chunks to tuples of `width` values, in order."""
        self.work, self.width, self.limit = work, width, limit
        self.columns: list[dict] = [{} for _ in range(width)]
        self.size = 0

    def learn(self, chunk_lists: Iterable[list[bytes]]) -> None:
        """Afterwards every chunk of these lists is in the table."""
        lists = list(chunk_lists)
        if self.size > self.limit:
            self.size = 0
            for c in self.columns:
                c.clear()
        known = self.columns[0]
        missing = list(set().union(*lists).difference(known))
        if missing:
            for column, values in zip(self.columns, zip(*self.work(missing), strict=True), strict=True):
                column.update(zip(missing, values, strict=True))
            self.size += sum(map(len, missing)) * (1 + self.width) + ENTRY_BYTES * len(missing)

    def column(self, k: int) -> Callable[[bytes], object]:
        return self.columns[k].__getitem__


_tables: dict[tuple, ChunkTable] = {}


def shared_table(key: tuple, make: Callable[[], ChunkTable]) -> ChunkTable:
    """This worker's table for the key."""
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]
