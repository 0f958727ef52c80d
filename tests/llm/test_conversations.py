"""Conversation repair against the best of all edit sequences, with and without segments."""

import hashlib
import random
import re
import zlib

import pytest

from rasterloom.llm import entry
from rasterloom.llm.conversations import conversation_edits, damaged, repaired_conversations

KIND = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def slow_summary(rows):
    """Of one conversation's rows (turn, role, text): every state with its best cost and letters, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen, marked = [0, 0, 0, 0], set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        faults[fault] += 1
        marked.append((role, text, fault))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := step.get((state, role[0]))) is not None:
                        new = (cost + 5, audit + "I", (*turns, f"{role}:"))
                        best[to] = min(best.get(to, new), new)
        return best

    best = inserted({"": (0, "", ())})
    for role, text, fault in marked:
        after = {}
        for state, (cost, audit, turns) in best.items():
            found = [(state, (cost + 2, audit + "D", turns))]
            if fault in (0, 3):
                if role[:1] in ("s", "u", "a") and (state, role[0]) in step:
                    found.append((step[state, role[0]], (cost + 5 * (fault == 3), audit + "K", (*turns, f"{role}:{text}"))))
                found += [(step[state, r[0]], (cost + 1 + 5 * (fault == 3), audit + "R", (*turns, f"{r}:{text}"))) for r in ("user", "assistant") if (state, r[0]) in step]
            for to, new in found:
                after[to] = min(after.get(to, new), new)
        best = inserted(after)
    cost, audit, turns = min(best[s] for s in ("", "a") if s in best)
    numbers = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def slow(rows, ids=()):
    by = {c: [] for c in ids}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    return {c: slow_summary(r) for c, r in by.items()}


def made(seed, convs, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "no.", "", " \n", "What? ", "x" * 30 + "!", "é?", "ok.\x85", None, "cut off, "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher", "Assistant"]
    rows = []
    for c in range(convs):
        for t in range(rnd.randrange(1, most)):
            if rnd.random() < 0.9:
                role = ("user", "assistant")[t % 2] if rnd.random() < 0.7 else rnd.choice(roles)
                text = f"Text {rnd.randrange(most)}." if rnd.random() < 0.6 else rnd.choice(texts)
                rows.append((None if c == 3 else c, None if rnd.random() < 0.03 else t * 2 - rnd.randrange(2) * 3, role, text))
    return rows


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("limits", [{}, {"long_rows": 10, "segment_rows": 4}, {"long_rows": 0, "segment_rows": 1}, {"long_bytes": 200, "segment_bytes": 90}])
def test_against_the_best_of_all_edits(spark, limits):
    rows = made(1, 120, 12) + made(2, 8, 300)
    found = repaired_conversations(spark.createDataFrame(rows, KIND).repartition(3), **limits).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == slow(plain(rows))
    assert len(found) == len({r[0] for r in rows})


def test_edits_are_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "You?"), (1, 2, "user", "You?"), (1, 4, "assistant", "Yes.")]
    (table,) = conversation_edits(spark.createDataFrame(rows, KIND))
    assert [tuple(r) for r in table.collect()] == [
        (1, 0, "system", "Be kind.", "K", 0, "system"), (1, 1, "user", "Hi.", "D", 0, "user"), (1, 2, "user", "You?", "K", 0, "user"), (1, 2, "user", "You?", "D", 2, "user"), (1, 4, "assistant", "Yes.", "K", 0, "assistant"),
    ]
    (table,) = conversation_edits(spark.createDataFrame([(1, 0, "user", "So."), (1, 1, "user", "Why?"), (1, 2, "assistant", "No."), (1, 3, "tool", "1."), (1, 4, "assistant", "2.")], KIND))
    assert [(r["edit"], r["role"], r["text"]) for r in table.collect()] == [("D", "user", "So."), ("K", "user", "Why?"), ("K", "assistant", "No."), ("R", "user", "1."), ("K", "assistant", "2.")]


def test_insertions(spark):
    """Where deleting costs more, turns are inserted: eight turns of a user's, with nothing between them."""
    rows = [(1, t, "user", f"Turn {t}.") for t in range(7)] + [(2, 0, "assistant", "Only this.")] + [(3, 0, "system", "S."), (4, 0, "user", "Cut")]
    found = {r["conv_id"]: (r["audit"], r["cost"]) for r in repaired_conversations(spark.createDataFrame(rows, KIND)).collect()}
    assert found == {c: (s[6], s[5]) for c, s in slow(rows).items()}


def test_op12(spark, small):
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = entry.op12_conversations(spark, small).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == slow(slow_damage(turns), {r[0] for r in turns}) and len(found) == len({r[0] for r in turns})


def test_damage_and_odd_rows(spark, tmp_path):
    """Null ids, turns, roles and texts, conversations that lose all rows, extra columns, repeated rows, no rows."""
    rows = made(5, 60, 6) + [(1000 + i, 0, "user", "x.") for i in range(40)]
    rows += rows[:20]
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], f"{KIND}, fault int, edit string")
    assert sorted(map(repr, (tuple(r) for r in damaged(frame).collect()))) == sorted(map(repr, slow_damage(rows)))
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    found = entry.op12_conversations(spark, str(tmp_path)).collect()
    want = slow(slow_damage(rows), {r[0] for r in rows})
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == want and len(found) == len(want)
    assert any(not w[6] and w[7] == hashlib.sha256().hexdigest() for w in want.values())
    assert repaired_conversations(frame.limit(0)).collect() == [] and entry.damaged(frame.limit(0)).collect() == []
