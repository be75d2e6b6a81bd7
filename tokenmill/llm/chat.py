"""Chat formatting by minimum-cost role repair.

A legal conversation is a path of the automaton start -> [system] -> user -> assistant ->
user -> ... that ends with the assistant. Each turn may be kept, relabelled, or merged into
the turn before it, and empty turns may be inserted; dynamic programming over the
automaton's states finds a repair of least cost. Equal costs are settled by a fixed
order (smaller state, a turn of its own before a merge), looking back from the end.

Conversations are range-partitioned by id and turn, so a very long one spans several
partitions. Least-cost steps compose: a part of a conversation is a small table of costs
from state to state. Only the first and last conversation of a partition can span
partitions; their tables (16 numbers each, two per partition) meet on the driver, which
hands every part its costs at entry and its state at exit.

Every input turn gives one row with its action and its fragment of the rendered text;
fragments in order are the rendered conversation, so no conversation is ever one value.

Defined cases: null and empty texts are empty turns; unknown and null roles can only be
relabelled or merged; turns with equal numbers are ordered by role, then by a hash of the
text, then by text, on any partitioning; ``pos`` numbers the turns of a conversation from 0
in that order; rows without a conversation id form one conversation; repeated rows are
repeated turns; markers inside texts are broken by a space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.base import stored

MERGE, RELABEL, INSERT = 1, 2, 3
ROLES = ("", "system", "user", "assistant")  # state 0 is the start
START, SYSTEM, USER, ASSISTANT = range(4)
#: Empty turns that make a role legal after a state (None: nothing does).
BETWEEN = {
    START: {SYSTEM: (), USER: (), ASSISTANT: (USER,)},
    SYSTEM: {SYSTEM: None, USER: (), ASSISTANT: (USER,)},
    USER: {SYSTEM: None, USER: (ASSISTANT,), ASSISTANT: ()},
    ASSISTANT: {SYSTEM: None, USER: (), ASSISTANT: (USER,)},
}
#: Empty turns that end a conversation.
CLOSING = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
_FAR = 1 << 50

ROWS = "conv_id long, pos long, turn long, old_role string, action string, role string, inserted array<string>, closing array<string>, fragment string"
_ROWS = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("old_role", pa.string()), ("action", pa.string()), ("role", pa.string()), ("inserted", pa.list_(pa.string())), ("closing", pa.list_(pa.string())), ("fragment", pa.string())])


def _steps(role: int):
    """(from, to, cost, merged?) for a turn of this role, in order of preference."""
    out = []
    for s in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            change = 0 if q == role else RELABEL
            if BETWEEN[s][q] is not None:
                out.append((s, q, INSERT * len(BETWEEN[s][q]) + change, False))
            if s == q:
                out.append((s, q, MERGE + change, True))
    return out


STEPS = {r: _steps(r) for r in range(4)}


def _code(role) -> int:
    return ROLES.index(role) if role in ROLES[1:] else 0


def forward(costs: list[int], codes: list[int]) -> list[list[int]]:
    """Least cost of each state after every turn, beginning with ``costs``."""
    out = [costs]
    for c in codes:
        now = [_FAR] * 4
        last = out[-1]
        for s, q, cost, _ in STEPS[c]:
            if last[s] + cost < now[q]:
                now[q] = last[s] + cost
        out.append(now)
    return out


def back(table: list[list[int]], codes: list[int], state: int) -> tuple[int, list[tuple[int, int, bool]]]:
    """The steps (from, to, merged?) of a least-cost path that ends in ``state``, and where it begins."""
    path = []
    for i in range(len(codes) - 1, -1, -1):
        s, q, merged = next((s, q, m) for s, q, cost, m in STEPS[codes[i]] if q == state and table[i][s] + cost == table[i + 1][q])
        path.append((s, q, merged))
        state = s
    return state, path[::-1]


def ending(costs: list[int]) -> int:
    """The state in which closing the conversation costs least."""
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(CLOSING[s]), s))


def _safe(text) -> str:
    return (text or "").replace("<|im_", "<| im_")


def _header(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_FOOTER = "<|im_end|>\n"


def rendered(path, texts, last: bool):
    """(action, role, inserted, closing, fragment) of each turn. ``last``: whether the conversation ends here."""
    for i, ((s, q, merged), text) in enumerate(zip(path, texts)):
        between = () if merged else BETWEEN[s][q]
        out = "\n" if merged else ("" if s == START else _FOOTER) + "".join(_header(r) + _FOOTER for r in between) + _header(q)
        out += _safe(text)
        closing = CLOSING[q] if last and i == len(path) - 1 else ()
        if last and i == len(path) - 1:
            out += _FOOTER + "".join(_header(r) + _FOOTER for r in closing)
        yield merged, q, [ROLES[r] for r in between], [ROLES[r] for r in closing], out


def _parts(batches):
    """((conversation, part), rows) of sorted batches whose first two columns are conversation and part."""
    held, key = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:2] != key:
                yield key, held
                held = []
            key = row[:2]
            held.append(row[2:])
    if held:
        yield key, held


_MARK = "conv_id long, turn long, role string, text string, part int, pos long, cost array<long>"


def _number(batches):
    """Rows with their partition and place; in the end a row for its first and its last conversation, with a cost table and, as ``-1 - pos``, the number of turns."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("pos", pa.int64()), ("cost", pa.list_(pa.int64()))])
    pos, key, ends, costs, size, seen = 0, None, [], None, 0, False
    unit = lambda: [[0 if i == j else _FAR for j in range(4)] for i in range(4)]
    for b in batches:
        if not b.num_rows:
            continue
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
        pos += n
        for conv, role in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if not seen or conv != key:
                if seen and not ends:
                    ends.append((key, costs, size))  # the first conversation is whole in this partition from here on
                key, costs, size, seen = conv, unit(), 0, True
            costs = [forward(c, [_code(role)])[1] for c in costs]
            size += 1
    if seen:
        ends.append((key, costs, size))
        k = len(ends)
        flat = [[min(x, _FAR) for row in c for x in row] for _, c, _ in ends]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in ends], pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.array([part] * k, pa.int32()), pa.array([-1 - n for _, _, n in ends], pa.int64()), pa.array(flat, pa.list_(pa.int64()))], schema=schema)


def _spanning(ends) -> dict:
    """Conversations that several partitions share: their parts in order with cost tables and numbers of turns."""
    by: dict = {}
    for r in sorted(ends, key=lambda r: r["part"]):
        by.setdefault(r["conv_id"], []).append((r["part"], np.array(r["cost"]).reshape(4, 4), -1 - r["pos"]))
    return {c: p for c, p in by.items() if len(p) > 1}


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn (see ``ROWS``): what was done to it and its fragment of the rendered conversation."""
    spark = turns.sparkSession
    t = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    # the key holds a hash of the text, not the text, so that range bounds stay small; the sort keeps to the same order
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    t = stored(t.mapInArrow(_number, _MARK), "turns")  # partitions are fixed from here on
    ends = t.where("pos < 0").select("conv_id", "part", "pos", "cost").collect()  # two per partition at most
    span = _spanning(ends)
    entry: dict = {}
    before: dict = {}  # turns of a conversation in earlier parts
    for conv, parts in span.items():
        costs, turns_before = np.array([0, _FAR, _FAR, _FAR]), 0
        for part, table, size in parts:
            entry[conv, part] = costs.tolist()
            before[conv, part] = turns_before
            turns_before += size
            costs = np.minimum((costs[:, None] + table).min(axis=0), _FAR)
        entry[conv, "end"] = costs.tolist()
    leave: dict = {}
    if span:
        # where a least-cost path through a part begins, for each state that it may end in
        known = spark.sparkContext.broadcast(entry)
        parts = sorted({p for (_, p) in entry if p != "end"})
        shared = t.where("pos >= 0").where(F.col("part").isin(parts)).where(F.col("conv_id").isin([c for c in span if c is not None]) | (F.col("conv_id").isNull() if None in span else F.lit(False)))

        def begin(batches):
            for (conv, part), rows in _parts(batches):
                if (conv, part) in known.value:
                    codes = [_code(r[0]) for r in rows]
                    table = forward(known.value[conv, part], codes)
                    starts = [back(table, codes, e)[0] if table[-1][e] < _FAR else -1 for e in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([starts], pa.list_(pa.int32()))], names=["conv_id", "part", "starts"])

        begun = shared.select("conv_id", "part", "role", "pos").repartition("part").sortWithinPartitions("part", "pos").mapInArrow(begin, "conv_id long, part int, starts array<int>").collect()
        starts = {(r["conv_id"], r["part"]): r["starts"] for r in begun}
        for conv, parts in span.items():
            state = ending(entry[conv, "end"])
            for part, _, _ in reversed(parts):
                leave[conv, part] = (state, part == parts[-1][0])
                state = starts[conv, part][state]
    plan = spark.sparkContext.broadcast((entry, leave, before))

    def write(batches):
        entry, leave, before = plan.value
        for (conv, part), rows in _parts(batches):
            codes = [_code(r[0]) for r in rows]
            table = forward(entry.get((conv, part), [0, _FAR, _FAR, _FAR]), codes)
            state, last = leave.get((conv, part), (ending(table[-1]), True))
            _, path = back(table, codes, state)
            columns: list[list] = [[] for _ in _ROWS]
            first = before.get((conv, part), 0)
            for i, (r, c, (merged, q, inserted, closing, out)) in enumerate(zip(rows, codes, rendered(path, [r[2] for r in rows], last))):
                action = ("merge" if merged else "keep") if c == q else ("relabel-merge" if merged else "relabel")
                for col, v in zip(columns, (conv, first + i, r[3], r[0], action, ROLES[q], inserted, closing, out)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

    rows = t.where("pos >= 0").select("conv_id", "part", "role", "pos", "text", "turn").repartition("part").sortWithinPartitions("part", "pos")
    return rows.mapInArrow(write, ROWS)

