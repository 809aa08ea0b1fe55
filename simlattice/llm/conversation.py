"""Conversation structure repair: turns aligned to every feasible length of the alternating grammar string.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. For a target string of that grammar the cheapest edits
are a Wagner-Fischer alignment of the turns to the string (Keep 0, Rerole 2, Delete 3, Insert 2, one more for an
undeleted truncated turn). Targets are tried in order of their least possible cost; the incumbent ends the search and
bounds each table to an Ukkonen band. Backtraced audits of equal cost are compared, the ASCII-least stays.

Turns are range-sorted by conversation and position and streamed, so no task gathers a conversation. A segment (the
part of a conversation that lies in one stretch of one task) is folded block by block: for every grammar state before
and after it, the best cost and audit. Two audits of equal cost over the same turns are never prefixes of one another
(further edits could only be inserts, which cost), so the best of each state pair composes; segments join the same way.
Only a conversation of several segments is read a second time, in order, to hash its repaired text.

Defined results: a null role or text counts as one space, and so does a null ``conv_id`` or ``turn`` in the damage key;
rows of a null ``conv_id`` are one conversation; null turns come first and count in no gap; rows of one turn are taken
by role, then text; an empty table gives no rows. Only the four columns are read, other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns that one alignment covers; longer segments are folded block by block.
BLOCK = 16
#: Bytes of text a segment holds to hash its repaired text at once; beyond, it is read a second time.
HELD = 8 << 20
_SPACE = " \t\n\x0b\x0c\r"
_ROLE = {"u": "user", "a": "assistant"}
_STATES = ("", "s", "U", "A")  # nothing yet, after the system turn, after a pair, after a user turn


def _targets(state: str, length: int) -> Iterator[tuple[str, str]]:
    """The grammar strings of ``length`` that can follow ``state``, each with the state after it."""
    def after(n: int, start: str) -> str:
        return ("U" if n % 2 == 0 else "A") if start != "A" else ("A" if n % 2 == 0 else "U")

    if state == "A":
        yield ("au" * length)[:length], after(length, "A")
    elif length == 0:
        yield "", state
    else:
        yield ("ua" * length)[:length], after(length, "U")
        if state == "":
            yield "s" + ("ua" * length)[:length - 1], after(length - 1, "U") if length > 1 else "s"


def _align(turns: str, target: str, bound: int) -> tuple[int, str] | None:
    """Cheapest edits from ``turns`` to ``target`` with the ASCII-least audit, if they cost no more than ``bound``.

    ``turns`` has a letter a turn: ``x`` must go, else the initial (``o``: any other), in capitals where truncated.
    """
    n, m = len(turns), len(target)
    gone = [0] * (n + 1)
    for i, t in enumerate(turns):
        gone[i + 1] = gone[i] + (t == "x")
    stay = n - gone[n]
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = table[i], table[i + 1] if i < n else {}
        kept, t = i - gone[i], turns[i] if i < n else "x"
        extra = TRUNCATED if t.isupper() else 0
        room = bound - DELETE * gone[n]
        # the band: (j - kept) inserts or (kept - j) deletes lead here, (m - j) - (stay - kept) of them lead on
        high, low = min(m, kept + room // INSERT), max(0, kept - room // DELETE)
        for j in range(high, low - 1, -1):
            here, on = j - kept, (m - j) - (stay - kept)
            if (INSERT * here if here > 0 else -DELETE * here) + (INSERT * on if on > 0 else -DELETE * on) > room:
                continue
            if i == n and j == m:
                row[j] = 0
                continue
            best = None
            if i < n and j in below:
                best = DELETE + below[j]
            if j < m and target[j] != "s" and j + 1 in row and (best is None or INSERT + row[j + 1] < best):
                best = INSERT + row[j + 1]
            if t != "x" and j < m and j + 1 in below:
                same = t.lower() == target[j]
                if same or target[j] != "s":
                    cost = (KEEP if same else REROLE) + extra + below[j + 1]
                    best = cost if best is None or cost < best else best
            if best is not None:
                row[j] = best
    cost = table[0].get(0)
    if cost is None or cost > bound:
        return None
    audit, i, j, left = [], 0, 0, cost
    while i < n or j < m:
        t = turns[i] if i < n else "x"
        if i < n and table[i + 1].get(j, bound + 1) + DELETE == left:
            audit.append("D")
            i, left = i + 1, left - DELETE
        elif j < m and target[j] != "s" and table[i].get(j + 1, bound + 1) + INSERT == left:
            audit.append("I")
            j, left = j + 1, left - INSERT
        else:
            same = t.lower() == target[j]
            audit.append("K" if same else "R")
            i, j, left = i + 1, j + 1, left - (KEEP if same else REROLE) - (TRUNCATED if t.isupper() else 0)
    return cost, "".join(audit)


@functools.lru_cache(1 << 16)
def align_block(turns: str, state: str) -> dict[str, tuple[int, str]]:
    """For each state that the block can end in, the least cost and its ASCII-least audit, from ``state`` on."""
    stay, gone = len(turns) - turns.count("x"), turns.count("x")
    late = sum(t.isupper() for t in turns)
    best: dict[str, tuple[int, str]] = {}

    def least(length: int) -> int:
        return DELETE * gone + (INSERT * (length - stay) if length > stay else DELETE * (stay - length))

    def incumbent(out: str) -> int:
        # deleting all turns and inserting the two that any state needs at most, or reroling all but the first
        return best[out][0] if out in best else DELETE * len(turns) + late + 3 * INSERT

    for length in sorted(range(0, stay + 2 + (DELETE * len(turns) + late + 3 * INSERT) // INSERT), key=least):
        if all(least(length) > incumbent(out) for out in _STATES):
            break
        for target, out in _targets(state, length):
            if least(length) <= incumbent(out):
                found = _align(turns, target, incumbent(out))
                if found and (out not in best or found < best[out]):
                    best[out] = found
    return best


Table = dict[str, dict[str, tuple[int, str]]]


def compose(first: Table, second: Table) -> Table:
    """Best cost and audit of two neighbouring stretches of turns for each state before and after them."""
    out: Table = {}
    for start, ends in first.items():
        best: dict[str, tuple[int, str]] = {}
        for middle, (cost, audit) in ends.items():
            for end, (more, rest) in second[middle].items():
                if end not in best or cost + more < best[end][0]:
                    best[end] = cost + more, audit + rest
                elif cost + more == best[end][0]:
                    best[end] = min(best[end], (cost + more, audit + rest))
        out[start] = best
    return out


def align(turns: str) -> Table:
    """The table of any number of turns, block by block, each block's halves joined first."""
    if len(turns) <= BLOCK:
        return {state: align_block(turns, state) for state in _STATES}
    half = -(-len(turns) // BLOCK) // 2 * BLOCK
    return compose(align(turns[:half]), align(turns[half:]))


def verdict(table: Table) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from nothing to nothing or to a pair."""
    return min(table[""][end] for end in ("", "U") if end in table[""])


class _Writer:
    """Feeds the repaired conversation to a hash, edit by edit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.hash, self.next, self.empty = audit, 0, hashlib.sha256(), "u", True

    def _line(self, role: str, text: str) -> None:
        self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False

    def _inserts(self) -> None:
        while self.audit.startswith("I", self.at):
            self._line(_ROLE[self.next], "")
            self.next, self.at = "a" if self.next == "u" else "u", self.at + 1

    def turn(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        self._line(role if edit == "K" else _ROLE[self.next], text)
        if not (edit == "K" and role.startswith("s")):
            self.next = "a" if self.next == "u" else "u"

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage: crc32 of ``conv_id:turn`` modulo 20 decides; nulls are one space."""
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(shown("text"), ".!?", ""))
            .otherwise(shown("text")))
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("kind", kind)
            .filter("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(shown("role")).alias("role"),
                    text.alias("text"), F.explode(F.expr("array_repeat(kind, if(kind = 3, 2, 1))")).alias("kind"))
            .drop("kind"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and position, numbered, with ``seen``: role and text stand at an earlier turn."""
    d = rows.withColumn("content", F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = (d.groupBy(F.col("conv_id").alias("conv"), F.col("content").alias("same"))
             .agg(F.min(place).alias("first")))
    d = (d.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("content") == F.col("same")))
         .select("conv_id", "turn", "role", "text", (F.col("first") < place).alias("seen")))
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    return (d.repartitionByRange(*by, F.substring("text", 1, 64))
            .sortWithinPartitions(*by, "text").withColumn("pos", F.monotonically_increasing_id()))


_STATS = ("blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, "
          "first_role string, last_role string, first_turn long, last_turn long")
_SEGMENT = f"conv_id long, pos long, {_STATS}, entries array<struct<start:string,end:string,cost:long,audit:string>>, " \
           "sha string"


class _Segment:
    """Folds one stretch of a conversation, turn by turn."""

    def __init__(self, conv, pos: int, held: int):
        self.held = held
        self.row = dict.fromkeys([f.split()[0] for f in _STATS.split(", ")]) | {"conv_id": conv, "pos": pos}
        self.row |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.table, self.turns, self.texts, self.bytes, self.next, self.before = None, [], [], 0, pos, None

    def turn(self, turn, role: str, text: str, seen: bool) -> None:
        row, shown = self.row, text.rstrip(_SPACE)
        seen = seen or self.before == (turn, role, text)
        letter = role[0] if role and role[0] in "sua" else "o"
        if not shown:
            kind, letter = "blank", "x"
        elif seen:
            kind, letter = "duplicate", "x"
        elif shown[-1] not in ".!?":
            kind, letter = "truncated", letter.upper()
        else:
            kind = None
        if kind:
            row[kind] += 1
        if self.before is None:
            row["first_role"], row["first_turn"] = role[:1], turn
        else:
            row["illegal"] += row["last_role"] + role[:1] not in ("su", "ua", "au")
        if turn is not None and (self.before is None or turn != self.before[0]):
            row["turns"] += 1
            row["least"], row["most"] = turn if row["least"] is None else row["least"], turn
        row["last_role"], row["last_turn"] = role[:1], turn
        self.before, self.next = (turn, role, text), self.next + 1
        self.turns.append(letter)
        if self.texts is not None:
            self.texts.append((role, text))
            self.bytes += len(text)
            if self.bytes > self.held:
                self.texts = None
        if len(self.turns) == BLOCK * 64:
            self._fold()

    def _fold(self) -> None:
        now = align("".join(self.turns))
        self.table, self.turns = now if self.table is None else compose(self.table, now), []

    def result(self) -> dict:
        self._fold()
        sha = None
        if self.texts is not None:
            writer = _Writer(verdict(self.table)[1])
            for role, text in self.texts:
                writer.turn(role, text)
            sha = writer.digest()
        entries = [{"start": s, "end": e, "cost": c, "audit": a}
                   for s, ends in self.table.items() for e, (c, a) in ends.items()]
        return self.row | {"entries": entries, "sha": sha}


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def _segments(schema: pa.Schema, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen", "pos")]
            for conv, turn, role, text, seen, pos in zip(*columns):
                if now is None or now.row["conv_id"] != conv or pos != now.next:
                    if now is not None:
                        out.append(now.result())
                    now = _Segment(conv, pos, held)
                now.turn(turn, role, text, seen)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            out.append(now.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, " \
          "audit string, repaired_sha256 string"


def _whole(parts: list[dict]) -> dict:
    """The result of a conversation from its segments, in order."""
    total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    whole, last = None, None
    for part in parts:
        now: Table = {s: {} for s in _STATES}
        for e in part["entries"]:
            now[e["start"]][e["end"]] = e["cost"], e["audit"]
        whole = now if whole is None else compose(whole, now)
        if last is not None:
            total["illegal"] += last["last_role"] + part["first_role"] not in ("su", "ua", "au")
            if part["first_turn"] is not None and part["first_turn"] == last["last_turn"]:
                total["turns"] -= 1
        last = part
    cost, audit = verdict(whole)
    least = min((p["least"] for p in parts if p["least"] is not None), default=None)
    most = max((p["most"] for p in parts if p["most"] is not None), default=None)
    turns = total.pop("turns")
    return total | {"conv_id": parts[0]["conv_id"], "gaps": 0 if least is None else most - least + 1 - turns,
                    "cost": cost, "audit": audit, "repaired_sha256": parts[0]["sha"] if len(parts) == 1 else None}


def _join(schema: pa.Schema):
    """Results of conversations whose segments follow one another in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, out = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if parts and parts[0]["conv_id"] != row["conv_id"]:
                    out.append(_whole(parts))
                    parts = []
                parts.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if parts:
            yield pa.RecordBatch.from_pylist([_whole(parts)], schema)
    return run


def _hashed(schema: pa.Schema):
    """Streams each conversation's audit (first) and turns in order; holds no more than the audit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, conv, out = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")]
            for c, pos, role, text in zip(*columns):
                if pos < 0:
                    if writer is not None:
                        out.append({"conv": conv, "digest": writer.digest()})
                    writer, conv = _Writer(text), c
                else:
                    writer.turn(role, text)
        if writer is not None:
            out.append({"conv": conv, "digest": writer.digest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def repair(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """Faults, cheapest repair and its hash for every conversation whose rows ``conversations`` are, taken as they are.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A stretch of a
    conversation with more than ``held`` characters is read a second time to hash its repaired text.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "conversation")
    rows = scratch.keep(_ordered(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                                      "role", "text")), "ordered")
    segments = rows.mapInArrow(_segments(_schema(_SEGMENT), held), _SEGMENT)
    found = scratch.keep(segments.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
                         .mapInArrow(_join(_schema(_RESULT)), _RESULT), "found")
    open_ = found.filter("repaired_sha256 IS NULL").select(F.col("conv_id").alias("conv"), F.col("audit").alias("edits"))
    again = (rows.join(open_.select("conv"), F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi")
             .select("conv_id", "pos", "role", "text")
             .unionByName(open_.select(F.col("conv").alias("conv_id"), F.lit(-1).cast("long").alias("pos"),
                                       F.lit("").alias("role"), F.col("edits").alias("text"))))
    hashes = (again.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
              .mapInArrow(_hashed(_schema("conv long, digest string")), "conv long, digest string"))
    return (found.join(hashes, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
            .withColumn("repaired_sha256", F.coalesce("repaired_sha256", "digest")).drop("conv", "digest"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of every conversation after the rule's damage; a conversation without rows left has zeros."""
    done = repair(damage(conversations)).withColumnRenamed("conv_id", "conv")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
