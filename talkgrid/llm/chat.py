"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation may open with the system and then alternates user and
assistant, beginning with the user and ending with the assistant. Each turn is
kept or relabelled, becomes a new message or is merged into the one before, and
empty messages may be put in where a turn is missing. Dynamic programming over
the automaton's states finds the cheapest way; costs of a run of turns form a
min-plus matrix over states, so long conversations are cut into blocks of turn
numbers that are solved on their own and chained through their matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm._arrow import in_small_batches
from talkgrid.session import durable

#: Turn numbers in a block, and blocks of turns without a number.
BLOCK, LOOSE = 256, 1 << 16
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("start", "system", "user", "assistant")
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of an empty insertion, of a merge, and of a relabel (dearer to or from the system, and of an unknown role).
INSERT, MERGE, RELABEL, RELABEL_SYSTEM, RELABEL_UNKNOWN = 3, 1, 2, 4, 1
FAR = 1 << 60

MESSAGES = "conv_id long, part long, rendered string, cost long, n_turns long, n_messages long, n_merged long, n_relabelled long, n_inserted long"


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty messages that lead legally from one state to just before another."""
    out = {}
    for a in LEGAL:
        reach = [((), a)]
        while reach:
            done, at = reach.pop(0)
            for b in LEGAL[at]:
                if (a, b) not in out:
                    out[a, b] = done
                    reach.append(((*done, b), b))
    return out


PATHS = _paths()


def _relabel(role: str | None, to: int) -> int:
    if role == ROLES[to]:
        return 0
    if role not in ROLES[1:]:
        return RELABEL_UNKNOWN
    return RELABEL_SYSTEM if SYSTEM in (to, ROLES.index(role)) else RELABEL


#: For each role: (from, to, cost, merged, inserted states), cheapest first for each pair of states.
def _moves(role: str | None) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    best: dict[tuple[int, int], tuple] = {}
    for to in (SYSTEM, USER, ASSISTANT):
        cost = _relabel(role, to)
        for a in LEGAL:
            options = [(cost + INSERT * len(PATHS[a, to]), False, PATHS[a, to])] if (a, to) in PATHS else []
            if a == to:
                options.append((cost + MERGE, True, ()))
            if options:
                best[a, to] = min(options, key=lambda x: x[0])
    return [(a, b, *x) for (a, b), x in best.items()]


_MOVES = {r: _moves(r) for r in (*ROLES[1:], None)}


def moves(role: str | None):
    return _MOVES[role if role in _MOVES else None]


#: Cost of ending in each state: the empty messages to the assistant's.
END = tuple(0 if s == ASSISTANT else INSERT * (len(PATHS[s, ASSISTANT]) + 1) for s in range(4))


def forward(roles: list[str | None], entry: list[int]) -> list[list[int]]:
    """Least costs of each state before the first turn and after every turn."""
    out = [entry]
    for role in roles:
        now = [FAR] * 4
        for a, b, cost, _, _ in moves(role):
            if out[-1][a] + cost < now[b]:
                now[b] = out[-1][a] + cost
        out.append(now)
    return out


def matrix(roles: list[str | None]) -> list[int]:
    return [min(FAR, x) for s in range(4) for x in forward(roles, [0 if a == s else FAR for a in range(4)])[-1]]


def trace(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, bool, tuple[int, ...]]]:
    """The cheapest moves from one state to another: for each turn its role, whether it is merged, and the states put in before it."""
    costs = forward(roles, [0 if a == entry else FAR for a in range(4)])
    out, state = [], leave
    for i in range(len(roles), 0, -1):
        a, _, _, merged, put = next(m for m in moves(roles[i - 1]) if m[1] == state and costs[i - 1][m[0]] + m[2] == costs[i][state])
        out.append((state, merged, put))
        state = a
    return out[::-1]


def escaped(text: str | None) -> str:
    """text without the markers: a backslash stands before each bar and backslash that follows a <, and taking it out again gives text."""
    return (text or "").replace("<\\", "<\\\\").replace("<|", "<\\|")


def render(turns: list[tuple[str | None, str | None]], entry: int, leave: int, last: bool) -> tuple:
    """The text of a block; a block that begins with a merge goes on with the message of the block before."""
    parts, merged_n, relabelled, inserted, messages, cost = [], 0, 0, 0, 0, 0
    is_open = entry != START

    def begin(state: int) -> None:
        nonlocal is_open, messages
        parts.append(("<|end|>\n" if is_open else "") + f"<|{ROLES[state]}|>\n")
        is_open = True
        messages += 1

    for (role, text), (state, merged, put) in zip(turns, trace([r for r, _ in turns], entry, leave), strict=True):
        for s in put:
            begin(s)
        if merged:
            parts.append("\n\n")
        else:
            begin(state)
        parts.append(escaped(text))
        merged_n += merged
        relabelled += role != ROLES[state]
        inserted += len(put)
        cost += _relabel(role, state) + MERGE * merged + INSERT * len(put)
    if last:
        for s in () if leave == ASSISTANT else (*PATHS[leave, ASSISTANT], ASSISTANT):
            begin(s)
            inserted += 1
            cost += INSERT
        parts.append("<|end|>\n")
    return "".join(parts), cost, len(turns), messages, merged_n, relabelled, inserted


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _matrices(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("m", pa.list_(pa.int64()))])
    return _batches(((*key, matrix([r[0] for r in rows])) for key, rows in _groups(batches, 2)), schema)


def _ahead(batches):
    """For each block the costs of the states before it, and whether it is the first of its conversation."""

    def rows():
        conv, costs = object(), None
        for batch in batches:
            for conv_id, part, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != conv or conv_id is None:
                    conv, costs = conv_id, [0, FAR, FAR, FAR]
                yield conv_id, part, m, costs
                costs = [min(FAR, *(costs[a] + m[4 * a + b] for a in range(4))) for b in range(4)]

    return _batches(rows(), pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("m", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64()))]))


def _back(batches):
    """The blocks from the last to the first: the states at their ends on the cheapest way."""

    def rows():
        conv, leave = object(), None
        for batch in batches:
            for conv_id, part, m, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = conv_id != conv or conv_id is None
                if last:
                    conv = conv_id
                    leave = min((1, 2, 3), key=lambda b: min(costs[a] + m[4 * a + b] for a in range(4)) + END[b])
                entry = min(range(4), key=lambda a: costs[a] + m[4 * a + leave])
                yield conv_id, part, entry, leave, last
                leave = entry

    return _batches(rows(), pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("last", pa.bool_())]))


def _rendered(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6]
    names = ["conv_id", "part", "rendered", "cost", "n_turns", "n_messages", "n_merged", "n_relabelled", "n_inserted"]
    rows = ((*key, *render([(r[0], r[1]) for r in turns], turns[0][2], turns[0][3], turns[0][4])) for key, turns in _groups(batches, 2))
    return _batches(rows, pa.schema(list(zip(names, kinds, strict=True))), 50)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conversation and block: conv_id, part, rendered, cost and counts.

    The parts of a conversation, joined in order, are its whole text. Turns go by
    turn, then role, then text, nulls first; repeated turns are turns of their
    own and merge; a null or unknown role may become any; a null text is empty;
    a text that holds a marker is escaped; null turns come first, ordered by a
    hash of their text in LOOSE parts and then as others; of the rows with a null
    conv_id nothing says that they belong together, so those of each role and
    text are a conversation of their own, told apart by part; other columns are
    ignored; an empty table gives no row.
    """
    hashed = F.xxhash64(F.lower(F.col("role").cast("string")), F.col("text").cast("string"))
    turn = F.col("turn").cast("long")
    part = F.when(F.col("conv_id").isNull(), hashed).when(turn.isNull(), F.lit(-(1 << 62)) + F.pmod(hashed, F.lit(LOOSE))).otherwise(F.floor(turn / BLOCK))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        part.cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.lower(F.col("role").cast("string")).alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    order = ["conv_id", "part", "turn", "role", "text"]
    dealt = in_small_batches(rows.drop("text")).repartition("conv_id", "part").sortWithinPartitions(*order[:-1])
    blocks = durable(dealt.select("conv_id", "part", "role").mapInArrow(_matrices, "conv_id long, part long, m array<long>"))
    alone = F.when(F.col("conv_id").isNull(), F.col("part"))
    ahead = durable(blocks.repartition("conv_id", alone).sortWithinPartitions("conv_id", "part").mapInArrow(_ahead, "conv_id long, part long, m array<long>, costs array<long>"))
    states = durable(ahead.repartition("conv_id", alone).sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(_back, "conv_id long, part long, entry long, leave long, last boolean"))
    x, y = rows.alias("x"), states.alias("y")
    joined = x.join(y, F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.part") == F.col("y.part"))).select("x.*", "entry", "leave", "last")
    return joined.repartition("conv_id", "part").sortWithinPartitions(*order).select("conv_id", "part", "role", "text", "entry", "leave", "last").mapInArrow(_rendered, MESSAGES)
