"""Bounded caches kept by a stream of operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.operators.lru import LruState
from rasterloom.schemas import CACHE_EVENT


def stream_replay(operations: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Outcomes (schemas.CACHE_EVENT) of operations (schemas.CACHE_OPERATION) as they come; a batch's are taken in order of seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = LruState.from_json(held.get[0], max_files, max_bytes) if held.exists else LruState(max_files, max_bytes)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            done = state.apply(r.op, r.source_id, r.extension or "", int(r.length) if r.length == r.length and r.length is not None else 0)
            out += [(key[0], r.seq, r.op, *x) for x in done]
        held.update((state.to_json(),))
        yield pd.DataFrame(out, columns=["cache_id", "seq", "op", "source_id", "outcome", "path"])

    return operations.groupBy("cache_id").applyInPandasWithState(step, CACHE_EVENT, "state string", "append", GroupStateTimeout.NoTimeout)
