"""Conversation repair against a search over all edit sequences and a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from simlattice.llm import conversation as C

ROLES = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}


def brute(turns):
    """Cheapest (cost, audit) over all edits, state by state (other than the tables of the operator)."""
    level = {"": (0, "")}
    for t in [*turns, None]:
        grown = dict(level)
        for _ in range(3):  # inserts before the turn
            for state, (cost, audit) in list(grown.items()):
                after = "U" if state == "A" else "A"
                new = cost + 2, audit + "I"
                if after not in grown or new < grown[after]:
                    grown[after] = new
        level = grown
        if t is None:
            return min(level[e] for e in ("", "U") if e in level)
        step = {}

        def put(state, cost, audit):
            if state not in step or (cost, audit) < step[state]:
                step[state] = cost, audit
        for state, (cost, audit) in level.items():
            put(state, cost + 3, audit + "D")
            if t != "x":
                extra, after = t.isupper(), "U" if state == "A" else "A"
                if t.lower() == ("a" if state == "A" else "u"):
                    put(after, cost + extra, audit + "K")
                else:
                    put(after, cost + 2 + extra, audit + "R")
                if t.lower() == "s" and state == "":
                    put("s", cost + extra, audit + "K")
        level = step


def test_align():
    for n in range(5):
        for turns in itertools.product("xsuaoSUA", repeat=n):
            assert C.verdict(C.align("".join(turns))) == brute(turns), turns
    rng = random.Random(3)
    for n in (7, 12, 16, 17, 40, 200):
        for _ in range(40):
            turns = "".join(rng.choice("xsuaoSUAOuauaua") for _ in range(n))
            assert C.verdict(C.align(turns)) == brute(turns), turns


def expected(rows):
    """The rules as they read, one conversation after another."""
    shown = lambda v: " " if v is None else str(v)
    out, by_conv = {}, {}
    for conv, turn, role, text in rows:
        mine = by_conv.setdefault(conv, [])
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, seen, letters = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), ""
        for _, role, text in mine:
            letter, last = role[:1] if role[:1] in ("s", "u", "a") else "o", re.sub(r"[ \t-\r]+\Z", "", text)[-1:]
            if not last:
                counts["blank"], letter = counts["blank"] + 1, "x"
            elif (role, text) in seen:
                counts["duplicate"], letter = counts["duplicate"] + 1, "x"
            elif last not in ".!?":
                counts["truncated"], letter = counts["truncated"] + 1, letter.upper()
            seen.add((role, text))
            letters += letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit = brute(letters)
        lines, left, expect = [], iter(mine), "user"
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, None, "")
            if edit != "D":
                role = role if edit == "K" else expect
                lines.append(f"{role}:{text}")
                expect = expect if role[0] == "s" else "assistant" if expect == "user" else "user"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"],
                     counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    texts = ["Fine.", "fine", "Really?", " ", "", None, "A longer answer that stops", "Stop!\x0b", "é. ", "x" * 3000]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u"]
    rows = []
    for _ in range(n):
        conv = rng.choice([None, 0, 7, *range(20, 60)])
        rows.append((conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)))
    return rows


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("hot", [0, 900])
def test_repair(spark, hot):
    rows = rows_of(5, 500) + [(60, k, "user" if k % 3 else "assistant", f"Turn {k % 700}{'.' * (k % 5)}")
                              for k in range(hot)] + [(60, 3, "user", "again.")] * (hot // 3)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows],
                               "conv_id long, turn long, role string, text string, pos long, kind string")
    assert result(C.repair_damaged(df)) == expected(rows)


def test_conversation_over_many_tasks(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"Turn {k}{'.' * (k % 4)}" + " word." * (k % 40)) for k in range(900)]
    rows += [(1, None, "system", "Be kind."), (2, 0, "user", "Hello."), (2, 1, "assistant", "Hi."), (1, 950, "user", "Turn 7....")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(C.repair_damaged(df)) == expected(rows)
        held = C.repair(C.damage(df), held=100)
        assert {r.conv_id: r.repaired_sha256 for r in held.collect()} == {k: v[-1] for k, v in expected(rows).items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.repair_damaged(spark.createDataFrame([], schema)).count() == 0
    turn = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    out = C.repair_damaged(spark.createDataFrame([(9, turn, "user", "Gone.")], schema)).collect()
    assert tuple(out[0]) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
