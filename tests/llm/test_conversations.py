"""Conversation repair against a plain forward search over all rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from aisleframe.llm import conversations
from aisleframe.llm.conversations import cheapest, repair

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def inserted(labels):
    for _ in range(6):
        for state, (cost, audit, rows) in list(labels.items()):
            for x, name in NAMES.items():
                to = STEP.get((state, x))
                if to and (cost + 5, audit + "I") < labels.get(to, (10**9, ""))[:2]:
                    labels[to] = (cost + 5, audit + "I", [*rows, (name, "")])
    return labels


def search(rows):
    labels = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}

        def put(state, label, new=new):
            if state and state[0] != "-" or state == "":
                if state not in new or label[:2] < new[state][:2]:
                    new[state] = label

        for state, (cost, audit, kept) in labels.items():
            put(state, (cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            if (state, role[:1]) in STEP:
                put(STEP[state, role[:1]], (cost + extra, audit + "K", [*kept, (role, text)]))
            for x, name in NAMES.items():
                if (state, x) in STEP:
                    put(STEP[state, x], (cost + 1 + extra, audit + "R", [*kept, (name, text)]))
        labels = inserted(new)
    return min((labels[s] for s in ("", "a") if s in labels), key=lambda label: label[:2])


def expected(table):
    out, groups = {}, defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv]
        role, text = (" " if x is None else x for x in (role, text))
        pick = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        groups[conv] += [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked, count = set(), [], defaultdict(int)
        for _, role, text in rows:
            end = text.strip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, kept = search(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


@pytest.fixture(scope="module")
def table():
    draw = np.random.default_rng(8)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "é!", "Yes. ", "word " * 3000, "Go!\t"]
    rows = [(int(c), int(t) if draw.random() > 0.1 else None, roles[draw.integers(len(roles))], texts[draw.integers(len(texts))])
            for c in range(150) for t in np.sort(draw.integers(0, 12, draw.integers(1, 9)))]
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"t {t}.") for t in range(9)]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"row {t}" + "." * (t % 3 > 0)) for t in range(400)]
    return rows + rows[:40]


def run(spark, table):
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(table)],
                                  "conv_id long, turn long, role string, text string, first int, kind string")
    return [tuple(r) for r in repair(frame.repartition(5)).collect()]


@pytest.mark.parametrize("segment", [1024, 3])
def test_repair(spark, table, segment, monkeypatch):
    """Short segments put even small conversations together from several."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    got = run(spark, table)
    want = expected(table)
    assert len(got) == len(want)
    assert {r[0]: r[1:] for r in got} == want


def test_lost_conversations_and_empty(spark):
    lost = next(i for i in range(999) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(lost, 1, "user", "Hi.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert run(spark, []) == []


def test_ties_take_the_least_audit():
    assert cheapest((("u", 1), ("u", 1), ("a", 1))) == (2, "DKK")
    assert cheapest((("a", 1),)) == (2, "D")
    assert cheapest((("s", 1), ("u", 1), ("a", 1))) == (0, "KKK")
    assert cheapest((), 0, (3,)) == (10, "II")
