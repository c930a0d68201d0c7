"""Repair of the role structure of conversations as a lightest derivation.

The rows of a conversation, and edits of them, are items of a weighted deduction system.  ``(i, q)``
says that the first i rows are dealt with and the roles given out so far lead the pattern
``(s?(ua)+)?`` to state q.  From it and an edit of row i follows an item with i + 1 rows; an inserted
turn leads on without a row; ``(n, q)`` with an accepting q gives the goal.  An edit adds its cost
and appends its initial to the audit.  Every cost is at least zero and only edits without cost take
a row further, so conclusions never precede their premises in the order of (cost, rows) and of two
audits of one item the smaller stays smaller when both grow: the functions are superior and
monotone.  Knuth's agenda pops items in that order, each once, until the goal is final.  Audits are
kept as links to the item before; two that compete for one item are compared back to where they
part, so memory grows with the rows, not with their square.

The rows of one conversation are read in order by one task, as an audit and a digest over them are
one value each; nothing else meets there.  The first pass sends only flags and digests of the rows;
texts are streamed past in the second and never held.

Nulls: a null role or text is one blank, null turns stand first, and rows without a conversation id
are one conversation.  Repeated rows are faults (duplicates), not lost.  Rows of one turn are ordered
by role and text digest, so ties have one order.  An empty table gives empty results.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import durable

# What an edit costs, what is added for a truncated row that stays, and the roles
# that may follow each other.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
NEIGHBOURS = {"su", "ua", "au"}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; which role leads where.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
BLANK, DUPLICATE, CUT, SOUND = 1, 2, 3, 0
#: Texts that are held at once while they stream past, and rows of one answer.
BATCH = 4096


class Step:
    """The last edit of an audit and the audit before it; ``jump`` is one further back."""

    __slots__ = ("before", "jump", "letter", "size")

    def __init__(self, before: Step | None, letter: str):
        self.before, self.letter = before, letter
        self.size = before.size + 1 if before else 0
        # Jumps of sizes as in skew binary numbers: any audit further back is a few jumps away.
        back = before.jump if before else self
        self.jump = back.jump if before and before.size - back.size == back.size - back.jump.size else before or self


def precedes(x: Step, y: Step) -> bool:
    """Whether audit x is less than audit y, neither being the beginning of the other.

    Equal beginnings of two audits are one object: the letters of an audit say which item it gives.
    """
    size = min(x.size, y.size)
    while x.size > size:
        x = x.jump if x.jump.size >= size else x.before
    while y.size > size:
        y = y.jump if y.jump.size >= size else y.before
    while x.before is not y.before:
        x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.before, y.before)
    return x.letter < y.letter


def lightest(rows: Sequence[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows given as (role initial, fault)."""
    start = Step(None, "")
    best: dict[tuple[int, int], tuple[int, Step]] = {(0, 0): (0, start)}
    agenda, final, n = [(0, 0, 0)], set(), len(rows)
    goal = None
    while agenda:
        cost, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        if state < 0:
            break
        final.add((i, state))
        audit = best[i, state][1]
        conclusions = [(i, NEXT[state][r], cost + INSERT, "I") for r in ROLES if r in NEXT[state]]
        if i == n:
            if state in ACCEPTING and (goal is None or (cost == goal[0] and precedes(audit, goal[1]))):
                goal = (cost, audit)  # the first is cheapest, as costs are popped in order
                heapq.heappush(agenda, (cost, n + 1, -1))
        else:
            role, fault = rows[i]
            conclusions.append((i + 1, state, cost + DELETE, "D"))
            if fault in (SOUND, CUT):
                extra = cost + (TRUNCATED if fault == CUT else 0)
                if role in NEXT[state]:
                    conclusions.append((i + 1, NEXT[state][role], extra, "K"))
                conclusions += [(i + 1, NEXT[state][r], extra + REROLE, "R") for r in ROLES if r in NEXT[state]]
        for at, to, total, letter in conclusions:
            if (at, to) in final:
                continue
            known, step = best.get((at, to)), Step(audit, letter)
            if known is None or total < known[0]:
                best[at, to] = (total, step)
                heapq.heappush(agenda, (total, at, to))
            elif total == known[0] and precedes(step, known[1]):
                best[at, to] = (total, step)
    letters, step = [], goal[1]
    while step.before is not None:
        letters.append(step.letter)
        step = step.before
    return goal[0], "".join(reversed(letters))


def apply(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Repaired turns (edit, role, text) as an audit has it, the rows (role, text) streaming past."""
    state, rows = 0, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = next(ROLES[r] for r in ROLES if r in NEXT[state])
        state = NEXT[state][role[:1]]
        yield letter, role, text


def _facts(rows: DataFrame, key: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """Rows in the private form that both passes read: what orders them, their faults, the text."""
    blank = F.lit(" ")
    named = rows.select(
        F.col(key).alias("_key"), F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role), blank).alias("_role"), F.coalesce(F.col(text), blank).alias("_text"), present.alias("_present"),
    )
    shown = F.rtrim("_text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(shown == "", BLANK).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return named.withColumns({"_fault": fault, "_digest": F.unhex(F.sha2("_text", 256))})


ORDER = ["_key", "_turn", "_role", "_digest"]  # ascending, nulls first


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(key, its rows one by one) of batches sorted by their first column."""
    from itertools import groupby

    stream = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    return ((key, (row[1:] for row in rows)) for key, rows in groupby(stream, key=lambda row: row[0]))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from itertools import islice

    rows = iter(rows)
    while some := list(islice(rows, BATCH)):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _review(rows: Iterator[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit) of (turn, role, digest, fault, present)."""
    seen, items, previous = set(), [], None
    tally = {BLANK: 0, DUPLICATE: 0, CUT: 0, SOUND: 0}
    low = high = None
    distinct = illegal = 0
    last_turn = object()
    for turn, role, digest, fault, present in rows:
        if not present:
            continue
        if turn is not None:  # turns come in order
            low, high = turn if low is None else low, turn
            distinct += turn != last_turn
            last_turn = turn
        mark = hashlib.blake2b(role.encode() + b":" + digest, digest_size=16).digest()
        if fault != BLANK and mark in seen:
            fault = DUPLICATE
        seen.add(mark)
        tally[fault] += 1
        initial = role[:1]
        illegal += previous is not None and previous + initial not in NEIGHBOURS
        previous = initial
        items.append((initial, fault))
    gaps = high - low + 1 - distinct if low is not None else 0
    return (gaps, tally[BLANK], tally[DUPLICATE], tally[CUT], illegal, *lightest(items))


def review(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """First pass, a row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``present`` is false for rows that only name their conversation; one without other rows has
    zeros and an empty audit.  ``audit`` holds the initials of the cheapest edits in order (Keep,
    Rerole, Delete, Insert), the least in ASCII order among equally cheap ones.
    """
    facts = _facts(rows, key, turn, role, text, F.lit(True) if present is None else present)
    facts = facts.select("_key", "_turn", "_role", "_digest", "_fault", "_present")
    kind = facts.schema["_key"].dataType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(0), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])
        every = _grouped(_chain(first, batches))
        yield from _batches(((k, *_review(found)) for k, found in every), schema)

    columns = ", ".join(f"{c} long" for c in COUNTS)
    placed = facts.repartition("_key").sortWithinPartitions(*ORDER)
    return placed.mapInArrow(answer, f"_key {kind}, {columns}, audit string").withColumnRenamed("_key", key)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _replayed(
    rows: DataFrame, reviewed: DataFrame, key: str, turn: str, role: str, text: str, present: Column | None
) -> DataFrame:
    """Each conversation's answer of the first pass followed by its rows in order, in one partition."""
    facts = _facts(rows, key, turn, role, text, F.lit(True) if present is None else present).where("_present")
    texts = facts.select("_key", F.lit(1).alias("_kind"), "_turn", "_role", "_digest", "_text")
    heads = reviewed.select(
        F.col(key).alias("_key"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"),
        F.lit(None).cast("binary").alias("_digest"), F.col("audit").alias("_text"),
    )
    every = heads.unionByName(texts).repartition("_key")
    return every.sortWithinPartitions("_key", "_kind", *ORDER[1:]).select("_key", "_role", "_text")


def repaired_turns(
    rows: DataFrame, reviewed: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """The repaired conversations: key, position from 0, edit (K, R or I), role, text."""
    source = _replayed(rows, reviewed, key, turn, role, text, present)
    kind = source.schema["_key"].dataType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(0), ("position", pa.int64()), *[(c, pa.string()) for c in ("edit", "role", "text")]])
        every = _grouped(_chain(first, batches))
        turns = ((k, at, *t) for k, found in every for at, t in enumerate(apply(next(found)[1], found)))
        yield from _batches(turns, schema)

    return source.mapInArrow(answer, f"_key {kind}, position long, edit string, role string, text string").withColumnRenamed("_key", key)


def digests(
    rows: DataFrame, reviewed: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """Per conversation: key and ``repaired_sha256`` of its repaired ``role:text`` joined by line feeds."""
    source = _replayed(rows, reviewed, key, turn, role, text, present)
    kind = source.schema["_key"].dataType.simpleString()

    def digest(found: Iterator[tuple]) -> str:
        sha = hashlib.sha256()
        for at, (_, role_, text_) in enumerate(apply(next(found)[1], found)):
            sha.update((b"\n" if at else b"") + f"{role_}:{text_}".encode())
        return sha.hexdigest()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(0), ("repaired_sha256", pa.string())])
        yield from _batches(((k, digest(found)) for k, found in _grouped(_chain(first, batches))), schema)

    return source.mapInArrow(answer, f"_key {kind}, repaired_sha256 string").withColumnRenamed("_key", key)


def repair(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """Both passes: what :func:`review` gives and ``repaired_sha256``; a row per conversation."""
    reviewed = durable(review(rows, key, turn, role, text, present))
    found = digests(rows, reviewed, key, turn, role, text, present)
    found = found.select(F.col(key).alias("_same"), "repaired_sha256")
    return reviewed.join(found, F.col(key).eqNullSafe(F.col("_same"))).drop("_same")
