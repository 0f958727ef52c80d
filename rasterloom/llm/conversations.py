"""Repair of a conversation's structure by the cheapest edits.

A row may be kept, given another role or deleted, and turns may be inserted anywhere, so that the roles become an
optional system turn and then user and assistant in turn. What has been emitted so far is one of four states; each
row is a 4 x 4 matrix of costs from state to state, insertions before it included. Conversations of like length make
one tensor with time as the first axis: costs to the end are worked out for all of them, turn by turn backwards, and
kept; then all of them walk forwards, where each takes the first edit by name of those that are on a cheapest way.

A conversation too long for that is cut into segments. A segment's matrices multiply (minimum of sums) to one; these
products, from a conversation's last to its first, give the costs behind every segment, with which each segment is
worked out alone for all four states that it may be entered in, and the state that one ends in picks the next one's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm.common import forget, written

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and bytes beyond which a conversation is cut into segments, and of a segment; rows that are worked out at once.
LONG_ROWS, LONG_BYTES, SEGMENT_ROWS, SEGMENT_BYTES, GROUP_ROWS, GROUP_BYTES = 4096, 8_000_000, 512, 100_000, 20_000, 8_000_000

_NEVER = 1 << 40
#: States: nothing yet, a system turn, a user's, an assistant's. Where a turn of each role leads from each, -1: nowhere.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The role that can be inserted, or given to a row, in each state: a user's, but an assistant's after a user's.
_NEW = np.array([2, 2, 3, 2])
#: Faults of rows, in order of precedence.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Rows are of a kind: role * 4 + fault; the last kind fills up shorter conversations.
_PAD = 16
_WHITE = b" \t\n\x0b\x0c\r"


def _matrices() -> tuple[np.ndarray, np.ndarray]:
    """For each kind: the costs of deleting, keeping and giving a role in each state (3 x 4), and the matrix from state
    to state, insertions before the row included."""
    ways = np.full((_PAD + 1, 3, 4), _NEVER)
    steps = np.full((_PAD + 1, 4, 4), _NEVER)
    before = _insertions()
    for role in range(4):
        for fault in range(4):
            kind, extra = role * 4 + fault, TRUNCATED * (fault == CUT)
            ways[kind, 0] = DELETE
            if fault not in (BLANK, DUPLICATE):
                ways[kind, 1] = np.where(_NEXT[:, role] >= 0, extra, _NEVER)
                ways[kind, 2] = REROLE + extra
            plain = np.full((4, 4), _NEVER)
            for s in range(4):
                plain[s, s] = DELETE
                for cost, to in ((ways[kind, 1, s], _NEXT[s, role]), (ways[kind, 2, s], _NEW[s])):
                    if cost < _NEVER:
                        plain[s, to] = min(plain[s, to], cost)
            steps[kind] = _then(before, plain)
    steps[_PAD] = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    return ways, steps


def _insertions() -> np.ndarray:
    """From state to state by insertions alone; after two of them every state that they lead to is reached."""
    out = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    for s in range(4):
        for k in (1, 2):
            to = _NEW[s] if k == 1 else _NEW[_NEW[s]]
            out[s, to] = min(out[s, to], INSERT * k)
    return out


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of cost matrices: minimum of sums."""
    return np.minimum(_NEVER, (a[..., :, :, None] + b[..., None, :, :]).min(-2))


_WAYS, _STEPS = _matrices()
#: Costs to end in each state: with nothing, or with an assistant's turn.
END = _insertions()[:, [_START, _ASSISTANT]].min(1)


def product(kinds: np.ndarray) -> np.ndarray:
    """(time, n) kinds to the (n, 4, 4) matrices from before the first row to behind the last."""
    out = np.broadcast_to(_STEPS[_PAD], (kinds.shape[1], 4, 4))
    for row in kinds:
        out = _then(out, _STEPS[row])
    return out


def costs_to_end(kinds: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(time + 1, n, 4): the least cost from before each row in each state, given that behind the last row (n, 4)."""
    out = np.empty((len(kinds) + 1, *end.shape), np.int64)
    out[-1] = end
    for t in range(len(kinds) - 1, -1, -1):
        out[t] = (_STEPS[kinds[t]] + out[t + 1][:, None, :]).min(-1)
    return np.minimum(out, _NEVER)


def trace(kinds: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the states before the first row: for each row the number of insertions before it (time, n), the state that
    they start in, the edit (0 delete, 1 keep, 2 another role; -1 where rows only fill up), and the last states (n).

    Of edits on a cheapest way that with the least letter is taken: D before I before K before R."""
    n, lane = kinds.shape[1], np.arange(kinds.shape[1])
    inserted, entered, edit = np.zeros(kinds.shape, np.int8), np.zeros(kinds.shape, np.int8), np.full(kinds.shape, -1, np.int8)
    state = state.copy()
    for t, row in enumerate(kinds):
        entered[t], open_ = state, row != _PAD
        for _ in range(3):
            best = costs[t][lane, state]
            after, ways = costs[t + 1], _WAYS[row, :, state]
            kept = _NEXT[state, np.minimum(row >> 2, 3)]
            delete = open_ & (ways[:, 0] + after[lane, state] == best)
            insert = open_ & ~delete & (INSERT + costs[t][lane, _NEW[state]] == best)
            keep = open_ & ~delete & ~insert & (kept >= 0) & (ways[:, 1] + after[lane, kept] == best)
            role = open_ & ~delete & ~insert & ~keep
            edit[t][delete], edit[t][keep], edit[t][role] = 0, 1, 2
            inserted[t] += insert
            state = np.where(insert | role, _NEW[state], np.where(keep, kept, state))
            open_ = insert
            if not insert.any():
                break
    return inserted, entered, edit, state


def _padded(kinds: list[np.ndarray]) -> np.ndarray:
    """Kinds of several conversations as a (time, n) array."""
    out = np.full((max(map(len, kinds), default=0), len(kinds)), _PAD, np.int64)
    for i, k in enumerate(kinds):
        out[: len(k), i] = k
    return out


def _initial(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


def fault_of(text: bytes, seen: bool) -> int:
    """The first fault of a text, seen: whether an earlier row has the same role and text."""
    bare = text.rstrip(_WHITE)
    if not bare:
        return BLANK
    if seen:
        return DUPLICATE
    return NONE if bare[-1:] in b".!?" else CUT


#: A row for each edit: of a deleted row its role and text as they were, of others as they become.
EDITS = "turn long, role string, text string, edit string, fault int, role_before string"
_LETTERS = pa.array(["D", "K", "R", "I"])
_NAMES = pa.array(["user", "assistant"])


def _edit_rows(t: pa.Table, kinds: list[np.ndarray], traced: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], ends: list[bool]) -> pa.RecordBatch:
    """The edits of conversations whose rows follow each other in t (conv, turn, role, text); traced: for each, what
    `trace` says of it; ends: whether a conversation ends behind its rows, so that turns may be added there."""
    sizes = np.array([len(k) + 1 for k in kinds])
    row = np.zeros(sizes.sum(), np.int64)  # a place behind each conversation's rows stands for its end
    inserted, entered, edit = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.full(len(row), -1)
    at, first = 0, 0
    for k, (ins, ent, ed, last), end in zip(kinds, traced, ends, strict=True):
        m = len(k)
        row[at : at + m + 1] = np.minimum(np.arange(first, first + m + 1), max(0, len(t) - 1))
        inserted[at : at + m], entered[at : at + m], edit[at : at + m] = ins[:m], ent[:m], ed[:m]
        entered[at + m] = last
        inserted[at + m] = (0, 2, 1, 0)[last] if end else 0
        row[at + m] = max(first, first + m - 1)
        at, first = at + m + 1, first + m
    each = inserted + (edit >= 0)
    source = np.repeat(np.arange(len(row)), each)
    within = np.arange(len(source)) - np.repeat(np.cumsum(each) - each, each)
    new = within < inserted[source]
    # insertions take turns; a row that is given a role follows them
    entered_at = np.where(inserted[source] % 2 * ~new, _NEW[entered[source]], entered[source])
    assistant = (np.where(new, (entered[source] == _USER) + within, entered_at == _USER) % 2).astype(np.int64)
    kind = np.concatenate([*kinds, np.zeros(1, np.int64)])
    rows = pa.array(row[source])
    taken = {c: t[c].combine_chunks().take(rows) if len(t) else pa.array([], t.schema.field(c).type) for c in ("conv", "turn", "role", "text")}
    added, none = pa.array(new), lambda kind_: pa.scalar(None, kind_)
    given = pa.array(new | (edit[source] == 2))
    return pa.RecordBatch.from_arrays([
        taken["conv"], pc.if_else(added, none(pa.int64()), taken["turn"]), pc.if_else(given, _NAMES.take(pa.array(assistant)), taken["role"]), pc.if_else(added, "", taken["text"]),
        _LETTERS.take(pa.array(np.where(new, 3, edit[source]))), pc.if_else(added, none(pa.int32()), pa.array((kind[row[source]] % 4).astype(np.int32))), pc.if_else(added, none(pa.string()), taken["role"]),
    ], ["conv", "turn", "role", "text", "edit", "fault", "role_before"])


def _kinds(roles: list[str], texts: list[str], seen: list[bool]) -> np.ndarray:
    return np.array([_initial(r) * 4 + fault_of(x.encode(), s) for r, x, s in zip(roles, texts, seen, strict=True)], np.int64)


def _whole(t: pa.Table, lengths: list[int]) -> pa.RecordBatch:
    """The edits of whole conversations: rows of t, as many for each as `lengths` says."""
    roles, texts = t["role"].to_pylist(), t["text"].to_pylist()
    kinds, at = [], 0
    for n in lengths:
        known: set = set()
        pairs = list(zip(roles[at : at + n], texts[at : at + n], strict=True))
        seen = [p in known or known.add(p) for p in pairs]
        kinds.append(_kinds(roles[at : at + n], texts[at : at + n], seen))
        at += n
    traced: list = [None] * len(kinds)
    bucket = np.array([len(k).bit_length() for k in kinds])
    for b in np.unique(bucket).tolist():  # lengths of a bucket differ by less than a factor of two
        mine = np.flatnonzero(bucket == b).tolist()
        tensor = _padded([kinds[i] for i in mine])
        inserted, entered, edit, last = trace(tensor, costs_to_end(tensor, np.broadcast_to(END, (len(mine), 4))), np.zeros(len(mine), np.int64))
        for j, i in enumerate(mine):
            traced[i] = (inserted[:, j], entered[:, j], edit[:, j], int(last[j]))
    return _edit_rows(t, kinds, traced, [True] * len(kinds))


def _borders(batch: pa.RecordBatch) -> list[int]:
    """Where the value of the first column changes, in a batch with rows; nulls are a value."""
    c = batch.column(0)
    if batch.num_rows < 2:
        return []
    a, b = c.slice(1), c.slice(0, len(c) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return (np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist()


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of one conversation each, and whether it is another one than that of the slice before."""
    before, any_before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = [0, *_borders(batch), batch.num_rows]
        for i, j in zip(bounds, bounds[1:], strict=False):
            part = batch.slice(i, j - i)
            key = part.column(0)[0].as_py()
            yield not any_before or key != before, part
            before, any_before = key, True


def _edits_of_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, role, text), all of a conversation one after the other: their edits."""
    held, lengths, size = [], [], 0
    for new, part in _by_conversation(batches):
        if new:
            if sum(lengths) > GROUP_ROWS or size > GROUP_BYTES:
                yield _whole(pa.Table.from_batches(held), lengths)
                held, lengths, size = [], [], 0
            lengths.append(0)
        held.append(part)
        lengths[-1] += part.num_rows
        size += part.nbytes
    if held:
        yield _whole(pa.Table.from_batches(held), lengths)


def _segments(rows: DataFrame, first: DataFrame, kind: str, seg_rows: int, seg_bytes: int) -> DataFrame:
    """Long conversations in segments: (conv, seg, kinds, matrix, rows), where rows is the segment as an Arrow stream.

    first: (conv, digest, known, first_turn) of what stands in a conversation more than once; in which turn first."""
    joined = rows.withColumn("digest", _digest()).join(first.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0))) > F.col("first_turn"), F.lit(False))
    flagged = joined.select("conv", "turn", "role", "text", later.alias("seen")).repartition("conv").sortWithinPartitions(*_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, last, held, size = 0, None, [], 0

        def done() -> pa.RecordBatch:
            nonlocal last
            t = pa.Table.from_batches(held)
            roles, texts, turns, seen = (t[c].to_pylist() for c in ("role", "text", "turn", "seen"))
            # rows of a turn stand in order of role and text: equal ones are neighbours
            for i, now in enumerate(zip(turns, roles, texts, strict=True)):
                seen[i], last = seen[i] or now == last, now
            kinds = _kinds(roles, texts, seen)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            matrix = product(kinds[:, None])[0]
            return pa.RecordBatch.from_arrays([t["conv"].combine_chunks()[:1], pa.array([seg], pa.int64()), pa.array([kinds.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["conv", "seg", "kinds", "matrix", "rows"])

        for new, part in _by_conversation(batches):
            if new and held:
                yield done()
                held, size = [], 0
            if new:
                seg, last = 0, None
            for at in range(part.num_rows):
                one = part.slice(at, 1)
                if held and (len(held) >= seg_rows or size >= seg_bytes):
                    yield done()
                    held, size, seg = [], 0, seg + 1
                held.append(one)
                size += len(one.column(3)[0].as_buffer() or b"")
        if held:
            yield done()

    return flagged.mapInArrow(run, f"conv {kind}, seg long, kinds binary, matrix binary, rows binary")


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, matrix), a conversation's last segment first, to (conv, seg, behind, ends)."""
    cost = END
    for new, part in _by_conversation(batches):
        out = []
        for i, m in enumerate(part.column(2).to_pylist()):
            if new and not i:
                cost = END
            out.append((cost.tobytes(), new and not i))
            cost = np.minimum(_NEVER, (np.frombuffer(m, np.int64).reshape(4, 4) + cost).min(1))
        behind, ends = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(behind, pa.binary()), pa.array(ends)], ["conv", "seg", "behind", "ends"])


def _edits_of_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, kinds, rows, behind, ends), segments in order, to edits. The segments of a batch are worked out
    together, each from all four states that it may be entered in."""
    state = 0
    for new, part in _by_conversation(batches):
        if new:
            state = 0
        for at in range(0, part.num_rows, 64):
            some = part.slice(at, 64).to_pylist()
            kinds = [np.frombuffer(r["kinds"], np.int64) for r in some]
            tensor, lanes = _padded(kinds), np.repeat(np.arange(len(some)), 4)
            costs = costs_to_end(tensor, np.array([np.frombuffer(r["behind"], np.int64) for r in some]))
            inserted, entered, edit, last = trace(tensor[:, lanes], costs[:, lanes], np.tile(np.arange(4), len(some)))
            for i, r in enumerate(some):
                k = 4 * i + state
                state = int(last[k])
                yield _edit_rows(pa.ipc.open_stream(r["rows"]).read_all(), [kinds[i]], [(inserted[:, k], entered[:, k], edit[:, k], state)], [r["ends"]])


#: Nulls come first, as everywhere in ascending order.
_ORDER = ["conv", "turn", "role", "text"]


def _digest() -> Column:
    return F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))


def conversation_edits(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES,
) -> tuple[DataFrame, ...]:
    """Tables (the conversation's column, and EDITS) that hold the cheapest edits of all conversations: a row for each
    row of turns and for each inserted turn. All rows of a conversation are in one partition of one table and in order.

    Rows are taken by turn, nulls first, and within a turn by role and text. A role counts by its first letter; s, u
    and a are known. fault: 0 none, 1 blank, 2 the role and text of an earlier row, 3 the last character that isn't
    white space is none of .!? (inserted turns: null). Null roles and texts count as a space; null conversations are
    one. Whole texts count, however long. Conversations of over long_rows rows or long_bytes bytes are worked out in
    segments, so a task holds one segment, or group of conversations, at a time. An empty table gives no edits.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    space = F.lit(" ")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    size = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = written(size.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv").alias("c")))
    several = bool(long.limit(1).count())
    of = lambda how: rows.join(long, F.col("conv").eqNullSafe(F.col("c")), how)
    schema = f"conv {kind}, {EDITS}"
    name = lambda df: df.withColumnRenamed("conv", conv_col)
    short = (of("left_anti") if several else rows).repartition("conv").sortWithinPartitions(*_ORDER)
    out = [name(short.mapInArrow(_edits_of_whole, schema))]
    if several:
        mine = of("left_semi")
        turn = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
        first = mine.groupBy("conv", _digest().alias("d")).agg(F.min(turn).alias("first_turn"), F.count("*").alias("n")).where("n > 1").drop("n")
        segments = written(_segments(mine, first, kind, segment_rows, segment_bytes))
        chain = segments.select("conv", "seg", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
        behind = chain.mapInArrow(_costs_behind, f"conv {kind}, seg long, behind binary, ends boolean").withColumnsRenamed({"conv": "c", "seg": "s"})
        both = segments.drop("matrix").join(behind, F.col("conv").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s")
        out.append(name(both.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_edits_of_segments, schema)))
    else:
        forget(long)
    return tuple(out)


class _Fold:
    """What is known of a conversation from its edits so far."""

    def __init__(self, conv: object):
        self.conv, self.low, self.high, self.turns, self.turn = conv, None, None, 0, None
        self.faults, self.illegal, self.before, self.cost = [0, 0, 0, 0], 0, None, 0
        self.audit, self.text, self.first = [], hashlib.sha256(), True

    def add(self, turn: int | None, role: str, text: str, edit: str, fault: int | None, before: str | None) -> None:
        if edit != "I":
            if turn is not None and turn != self.turn:
                self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
            self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + before[:1] not in ("su", "ua", "au")
            self.before = before[:1]
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == CUT and edit != "D")
        if edit != "D":
            self.text.update(f"{'' if self.first else '\n'}{role}:{text}".encode())
            self.first = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.text.hexdigest())


def conversation_summary(edits: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each conversation of one table of `conversation_edits`: gaps between the turns' numbers, rows by
    fault, neighbouring roles that can't follow each other, the edits' cost and letters, and the SHA-256 of the turns
    that remain, which a task reads one after the other and doesn't hold."""
    kind = edits.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [schema, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _SUMMARY)

        fold, done = None, []
        for new, part in _by_conversation(batches):
            schema = part.schema.field(0).type
            if new:
                if fold:
                    done.append(fold.row())
                fold = _Fold(part.column(0)[0].as_py())
                if len(done) >= 1000:
                    yield table(done)
                    done = []
            columns = [part.column(k).to_pylist() for k in range(1, 7)]
            fold.audit.append("".join(columns[3]))
            for r in zip(*columns, strict=True):
                fold.add(*r)
        if fold:
            yield table([*done, fold.row()])

    found = edits.select(F.col(conv_col).alias("conv"), *StructType.fromDDL(EDITS).names)
    return found.mapInArrow(run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").withColumnRenamed("conv", conv_col)


_SUMMARY = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired_conversations(turns: DataFrame, conv_col: str = "conv_id", ids: DataFrame | None = None, **columns: str | int) -> DataFrame:
    """`conversation_summary` over all conversations of turns. ids: a table with a row for each conversation; those
    without a row in turns get zeros, no edits and the hash of an empty text."""
    tables = [conversation_summary(t, conv_col) for t in conversation_edits(turns, conv_col, **columns)]
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    if ids is None:
        return found
    names = found.columns[1:]
    some = found.withColumnRenamed(conv_col, "conv_")
    zeros = {c: F.lit("") if c == "audit" else F.lit(hashlib.sha256().hexdigest()) if c == "repaired_sha256" else F.lit(0).cast("long") for c in names}
    joined = ids.select(conv_col).distinct().join(some, F.col(conv_col).eqNullSafe(F.col("conv_")), "left")
    return joined.select(conv_col, *[F.coalesce(c, zeros[c]).alias(c) for c in names])


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32(`conversation:turn`) modulo 20: 0 goes, 1 loses its text, 2 its .!?, 3 comes
    twice, 4 becomes a user's. Nulls count as a space."""
    space = F.lit(" ")
    some = lambda c: F.coalesce(F.col(c).cast("string"), space)
    k = F.crc32(F.concat(some(conv_col), F.lit(":"), some(turn_col)).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(some(text_col), "[.!?]", "")).otherwise(some(text_col))
    role = F.when(k == 4, "user").otherwise(some(role_col))
    rows = turns.select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), k.alias("k")).where("k <> 0")
    return rows.select(conv_col, turn_col, role_col, text_col, F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
