"""The state of one bounded least-recently-used cache, and what an operation does to it.

A small helper of the batch replay and of the stream; both call `LruState.apply` in the order of a cache's operations.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass
class LruState:
    """entries: id to [path, bytes], the least recently used first; orphans: files that no entry points to any more."""

    max_files: int
    max_bytes: int
    entries: dict[str, list] = field(default_factory=dict)
    orphans: dict[str, int] = field(default_factory=dict)
    missing: set[str] = field(default_factory=set)

    @property
    def disk(self) -> int:
        return sum(n for _, n in self.entries.values()) + sum(self.orphans.values()) - sum(self.entries[k][1] for k in self.missing if k in self.entries)

    def apply(self, op: str, source_id: str, extension: str = "", length: int = 0) -> list[tuple[str, str, str]]:
        """Outcomes (id, outcome, path). get: hit, stale or miss; add: evicted_count and evicted_size, then added, or
        failed where a limit of no files can't be kept; lost: the id's file is gone, though its entry stays."""
        if op == "get":
            return [self._get(source_id)]
        if op == "lost":
            if source_id in self.entries:
                self.missing.add(source_id)
            return []
        if op != "add":
            raise ValueError(f"unknown operation {op!r}")
        return self._add(source_id, f"{source_id}{extension}", length)

    def _get(self, source_id: str) -> tuple[str, str, str]:
        if source_id not in self.entries:
            return source_id, "miss", ""
        path, length = self.entries.pop(source_id)
        if source_id in self.missing:
            self.missing.discard(source_id)
            return source_id, "stale", path
        self.entries[source_id] = [path, length]
        return source_id, "hit", path

    def _drop_oldest(self) -> tuple[str, str, int]:
        key = next(iter(self.entries))
        path, length = self.entries.pop(key)
        return key, path, length

    def _add(self, source_id: str, path: str, length: int) -> list[tuple[str, str, str]]:
        out = []
        while len(self.entries) >= self.max_files:
            if not self.entries:
                return [*out, (source_id, "failed", "")]
            key, old, _ = self._drop_oldest()
            self.missing.discard(key)
            out.append((key, "evicted_count", old))
        total = self.disk
        while total > self.max_bytes and self.entries:
            key, old, size = self._drop_oldest()
            if key in self.missing:  # its size can't be read: no more is evicted this time
                self.missing.discard(key)
                break
            out.append((key, "evicted_size", old))
            total -= size
        before = self.entries.pop(source_id, None)
        if before and before[0] != path and source_id not in self.missing:
            self.orphans[before[0]] = before[1]
        self.orphans.pop(path, None)
        self.missing.discard(source_id)
        self.entries[source_id] = [path, length]
        return [*out, (source_id, "added", path)]

    def to_json(self) -> str:
        return json.dumps([self.entries, self.orphans, sorted(self.missing)])

    @classmethod
    def from_json(cls, text: str, max_files: int, max_bytes: int) -> LruState:
        entries, orphans, missing = json.loads(text)
        return cls(max_files, max_bytes, entries, orphans, set(missing))
