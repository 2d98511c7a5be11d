"""Conversation repair against a plain search over edits."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from aislelens.llm import conversations as op
from aislelens.llm.common import table
from aislelens.session import scratch_path
from tests.helpers import canon

SCHEMA = "conv_id long, turn long, role string, text string, rid string, seg string, key string, place string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        show = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(":".join(show).encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if hit == 3 else 1)


def order(r):
    conv = "-" if r[0] is None else str(r[0])
    key = hashlib.sha256(f"{conv}:{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return r[1] is not None, r[1] or 0, key


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(WHITE)
        fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                 "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append(fault)
    return out


def least(rows, found):
    """(cost, audit, lines) of the cheapest edits, the ASCII-least of them, by trying all."""
    n = len(rows)
    then = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, added):
        out = []
        if i == n and state in ("", "a"):
            out.append((0, "", ()))
        if added < 2:  # two in a row come back to the same state
            c, a, x = best(i, then[state], added + 1)
            out.append((c + 2, "I" + a, (name[then[state]] + ":", *x)))
        if i < n:
            c, a, x = best(i + 1, state, 0)
            out.append((c + 3, "D" + a, x))
            if found[i] not in ("blank", "duplicate"):
                more, (_, _, role, text) = found[i] == "truncated", rows[i]
                first = role[:1]
                if first == then[state] or first == "s" and state == "":
                    c, a, x = best(i + 1, first, 0)
                    out.append((c + more, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = best(i + 1, then[state], 0)
                out.append((c + 2 + more, "R" + a, (f"{name[then[state]]}:{text}", *x)))
        return min(out) if out else (10 ** 9, "", ())

    return best(0, "", 0)


def plain(rows):
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=order)
        found = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, lines = least(own, found)
        first = [r[2][:1] for r in own]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in (
            "blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(canon(x) for x in out)


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role,
                         rng.choice(["Yes.", "No", "Why?", " ", "", None, "Well! \n", "Some text é 😀."])))
    return rows


def queried(spark, rows, parts=3):
    folder = scratch_path(spark, "conv")
    data = [(*r, "x", "x", "x", "x") for r in rows]
    spark.createDataFrame(data, SCHEMA).repartition(parts).write.parquet(f"{folder}/conversations.parquet")
    return sorted(canon(tuple(r)) for r in op.query(spark, folder).collect())


def test_odd_rows(spark):
    rows = made(1, 60, 9) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None), (500, 3, "user", None)]
    rows += [(501, t, "user", "word " * 40_000 + ".") for t in range(3)] + [(502, None, "user", "Hi.")] * 5
    rows += [(503, 5, "tool", "x."), (503, 5, "Assistant", "x."), (503, 5, "assistant", "y."), (-7, -3, "user", "a."), (-7, 9, "assistant", "b!")]
    assert queried(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_conversations_cut_into_segments(spark, monkeypatch, size):
    monkeypatch.setattr(op, "SEGMENT_ROWS", size)
    monkeypatch.setattr(op, "LEAST_SEGMENTS", 1)
    rows = made(2, 6, 12)
    rng = random.Random(3)
    rows += [(100, t, rng.choice(["user", "assistant", "system"]), f"Text {t % 50}" + rng.choice(["", "."])) for t in range(150)]
    assert queried(spark, rows) == plain(rows)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(canon(tuple(r)) for r in op.query(spark, folder).collect()) == plain(rows)


def test_paths_of_random_runs():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        roles = [rng.choice(["user", "assistant", "system", "tool"]) for _ in range(n)]
        kinds = [rng.choice(["", "blank", "duplicate", "truncated"]) for _ in range(n)]
        cost, audit, _ = least([(0, 0, r, "") for r in roles], kinds)
        initial = np.array([("sua" + r[0]).find(r[0]) for r in roles])
        fault = np.array([["", "blank", "duplicate", "truncated"].index(k) for k in kinds])
        paths = op.Paths(initial, fault, np.array([n]), op.GOAL[None], np.array([True]))
        _, letter, _, _, total = paths.read(np.array([0]))
        assert (int(total[0]), bytes(op.LETTERS[k] for k in letter).decode()) == (cost, audit)


def test_empty(spark):
    assert queried(spark, []) == []
