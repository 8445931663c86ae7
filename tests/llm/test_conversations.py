"""Conversation repair: edits against all edit strings, whole results against a plain version."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from docquarry.llm import conversations as C
from docquarry.llm import queries

GOAL = re.compile("(s?(ua)+)?")


def every_edit(roles: str, faults: str) -> tuple[int, str]:
    """The cheapest, then least, of all edit strings with at most two inserts at a place."""
    found = []

    @lru_cache(maxsize=None)
    def rest(i: int, state: str, inserts: int) -> tuple:
        """All (cost, audit) from turn i on in this state of the goal."""
        out = []
        if i == len(roles) and state in ("", "a"):
            out.append((0, ""))
        turn = "a" if state == "u" else "u"
        if inserts < 2:
            out += [(c + 3, "I" + a) for c, a in rest(i, turn, inserts + 1)]
        if i < len(roles):
            out += [(c + 4, "D" + a) for c, a in rest(i + 1, state, 0)]
            if faults[i] not in "bd":
                own = 3 * (faults[i] == "t")
                if roles[i] == turn or (roles[i] == "s" and state == ""):
                    out += [(c + own, "K" + a) for c, a in rest(i + 1, roles[i], 0)]
                out += [(c + own + 3, "R" + a) for c, a in rest(i + 1, turn, 0)]
        least = min((c for c, _ in out), default=0)
        return tuple(x for x in out if x[0] <= least + 8)

    found = rest(0, "", 0)
    return min(found)


def test_edits_are_the_cheapest_and_then_the_least():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.integers(0, 7))
        roles, faults = "".join(rng.choice(list("suax"), n)), "".join(rng.choice(list("----tbd"), n))
        cost, audit, at = C.cheapest(roles, faults)
        assert (cost, audit) == every_edit(roles, faults), (roles, faults)
        assert len(at) == n and all(audit[x] in "IDKR" for x in at)
        made = "".join(r[:1] for e, r, _ in C.applied("", audit, [C.NAMES.get(x, x) for x in roles], [""] * n) if e != "D")
        assert GOAL.fullmatch(made), (roles, faults, audit)


def order(x):
    return (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode())


def plainly(rows: list[tuple]) -> list[tuple]:
    """(conv, counts, audit, digest) of (conv, turn, role, text) rows after the damage of the query."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        held = convs.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            row = (conv, turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            held += [row] * (2 if d == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=order)
        seen, faults = set(), ""
        for _, _, role, text in held:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = "".join(x[2][:1] if x[2][:1] in ("s", "u", "a") else "x" for x in held)
        turns = {x[1] for x in held} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, _ = C.cheapest(initials, faults)  # held against every edit string above
        made, state, i = [], "", 0
        for edit in audit:
            turn = "a" if state == "u" else "u"
            if edit == "I":
                made.append({"u": "user:", "a": "assistant:"}[turn])
                state = turn
                continue
            _, _, role, text = held[i]
            i += 1
            if edit == "K":
                made.append(f"{role}:{text}")
                state = role[0]
            elif edit == "R":
                made.append({"u": "user:", "a": "assistant:"}[turn] + text)
                state = turn
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def made(df, **options) -> list[tuple]:
    turns, absent = C.damaged(df)
    return sorted((tuple(x) for x in C.audits(turns, conv_col="conv", absent=absent, **options).select("conv", *C.COUNTS, "audit", "repaired_sha256").collect()), key=repr)


def random_rows(seed: int, convs: int, turns: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No", "", " \t", None, "What?", "A longer\nanswer.", "ü!", "end. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    return [(c, pick([t, t, t, t + 1, None]), pick(roles), pick(texts) if rng.random() < 0.5 else f"Text {rng.integers(9)}.") for c in range(convs) for t in range(int(rng.integers(1, turns)))]


@pytest.mark.parametrize("segment", [1000, 3])
def test_results_equal_a_plain_version(spark, segment):
    """With segments of three turns nearly every conversation takes the path of long ones."""
    rows = [*random_rows(1, 60, 12), (None, 1, "user", "Hi."), (None, None, None, None), (7, 2, "user", "Yes.")]
    rows += [(500, 1, "user", "Same.")] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(df, segment_turns=segment) == plainly(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(1, t, ["user", "assistant", "system"][t % 3], f"Turn {t % 400}" + "." * (t % 5 > 0)) for t in range(5000)] + [(2, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert made(df) == plainly(rows)


def test_whole_table_equals_a_plain_version(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_conversations(spark, "/root/testdata/sf0.01")
    assert found.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in found.collect()), key=repr) == plainly(rows)


@pytest.mark.parametrize("segment", [1000, 3])
def test_repaired_turns_give_the_digest(spark, segment):
    rows = [*random_rows(2, 30, 10), *((99, t, "user", f"Turn {t}.") for t in range(2500))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", place int, conv string").repartition(3)
    want = {x.conv: x.repaired_sha256 for x in C.audits(df).collect()}
    found: dict = {}
    for x in sorted(C.repair(df, segment_turns=segment).collect(), key=lambda x: (x.conv, x.place)):
        held = found.setdefault(x.conv, [])
        assert x.place == len(held)
        held.append(f"{x.role}:{x.text}")
    assert {c: hashlib.sha256("\n".join(found.get(c, [])).encode()).hexdigest() for c in want} == want


def test_empty_table(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []
