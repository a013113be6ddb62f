"""Repair of conversations, against every way to edit small ones and a plain search on large ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from sightline.llm import conversations
from sightline.llm.queries import queries

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, n long, part int, blank boolean"


def damage(rows):
    """The rows of one conversation, damaged and in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = NOT_SPACE.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows, marks):
    """(cost, audit, lines): the cheapest edits, of these the least audit, by a search from the first row on."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def with_inserts(states):
        for _ in range(4):
            for q, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    if to := move.get((q, role[0])):
                        states[to] = min(states.get(to, (10**9, "", [])), (cost + 2, audit + "I", [*lines, f"{role}:"]))
        return states

    states = with_inserts({"": (0, "", [])})
    for (_, role, text), mark in zip(rows, marks):
        new: dict = {}

        def put(q, *x):
            new[q] = min(new.get(q, (10**9, "", [])), x)

        for q, (cost, audit, lines) in states.items():
            put(q, cost + 3, audit + "D", lines)
            if mark not in ("blank", "duplicate"):
                more = mark == "truncated"
                if to := move.get((q, role[:1])):
                    put(to, cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    if to := move.get((q, other[0])):
                        put(to, cost + 2 + more, audit + "R", [*lines, f"{other}:{text}"])
        states = with_inserts(new)
    return min(states[q] for q in ("", "a") if q in states)


def brute(rows):
    convs: dict = {}
    for r in rows:
        convs.setdefault(r[0], []).append(tuple(r)[:4])
    out = {}
    for conv, own in convs.items():
        found = damage(own)
        marks = faults(found)
        turns = {t for t, _, _ in found if t is not None}
        cost, audit, lines = best_edits(found, marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_by(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def odd_rows(seed, n=600):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "usher", "tool", "", None, "Assistant"]
    texts = ["Yes.", "No", "", " \t\n", None, "Why? \r\n", "é!", "a.b", "...", "Long " * 50 + ".", "x\x00y?", "line\nline."]
    rows = []
    for _ in range(n):
        conv = rng.choice([None, 1, 1, 1, 2, 3, rng.randrange(100)])
        rows.append((conv, rng.choice([None, rng.randrange(40), rng.randrange(5), -3]), rng.choice(roles), rng.choice(texts), 5, 6, None))
    return rows + rows[:20]


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found_by(queries()["op11_conversation_repair"](spark, data)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows(spark, seed):
    rows = odd_rows(seed)
    assert found_by(conversations.repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_conversation_over_all_partitions(spark):
    """Pieces on both sides of every border, with text in several chunks."""
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A", "B?", "", f"text {i}."]) + "y" * rng.choice([0, 300]) + rng.choice(["", "."]), 0, 0, None) for i in range(900)]
    rows += [(7, 901, "user", "same.", 0, 0, None)] * 500
    before = spark.conf.get("spark.sql.shuffle.partitions")
    chunk, conversations.CHUNK = conversations.CHUNK, 1000
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = found_by(conversations.repair(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        conversations.CHUNK = chunk
    assert got == brute(rows)


def test_all_dropped_and_empty(spark):
    turns = [t for t in range(200) if crc32(f"9:{t}".encode()) % 20 == 0]
    rows = [(9, t, "user", "x", 0, 0, None) for t in turns]
    assert found_by(conversations.repair(spark.createDataFrame(rows, SCHEMA))) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_automaton_stays_small():
    rng = random.Random(1)
    automaton = conversations.Automaton()
    for _ in range(2000):
        symbols = [(rng.randrange(9), 1) for _ in range(rng.randrange(30))]
        after, cost = automaton.scan(symbols, conversations.FINAL)
        letters, end = automaton.trace(symbols, after, 0)
        roles = "".join(letters) + conversations.ending(end)
        assert cost[0] == 3 * roles.count("D") + 2 * roles.count("I") + 2 * roles.count("R") + sum((s - 1) % 2 for (s, _), x in zip(symbols, letters) if s and x[-1] != "D")
    assert len(automaton.vectors) < 60
