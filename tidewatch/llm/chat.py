"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, beginning with user.  Dynamic programming over this automaton
chooses for each given turn one of: keep it, relabel it, or merge it into the
turn before (same role); and before a turn an empty turn of the missing role may
be inserted.  Each choice has a cost, the cheapest sequence is rendered.

Conversations of up to ``part_turns`` turns meet in one task each: one shuffle of
their texts, sorted, and repaired one conversation at a time.  A longer
one may be longer than any task should hold.  Its turns are range-sorted and get their
places from counts by partition; they form blocks of ``part_turns`` turns.  Each
block is reduced to a small matrix, without texts: the least cost from each state before it
to each state after it.  Matrices compose (min, +), first within groups of blocks and then
over groups, so the best states at all borders follow without any block's turns,
and every block is then repaired by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

# states: what the sequence so far ends with
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Roles under other names (fixed values); anything else is unknown.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
#: What may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of merging two turns of one role, of an inserted empty turn, and of relabelling a known or an unknown role.
MERGE, INSERT, RELABEL, NAME = 1, 3, 4, 2
#: Turns of a rendered part; shorter conversations are one part.  Parts whose matrices are composed together.
PART_TURNS, GROUP_PARTS = 4096, 4096
_FAR = 1 << 40


def _moves() -> dict[tuple[int, int], list[tuple[int, int, str, int | None]]]:
    """(state, given role or 0 for unknown): (cost, new state, action, inserted role), cheapest and plainest first."""
    out = {}
    for state in range(4):
        for given in range(4):
            label = lambda r: 0 if r == given else NAME if given == 0 else RELABEL  # noqa: B023, E731
            moves = []
            for r in ROLES:
                how = "keep" if r == given else "relabel"
                if r in NEXT[state]:
                    moves.append((label(r), r, how, None))
                if r == state:
                    moves.append((MERGE + label(r), r, "merge", None))
                for mid in NEXT[state]:
                    if r in NEXT[mid] and mid != START:
                        moves.append((INSERT + label(r), r, how, mid))
            out[state, given] = sorted(moves, key=lambda m: (m[0], ("keep", "merge", "relabel").index(m[2]), m[3] is not None, m[1]))
    return out


MOVES = _moves()
_BEST = {k: {s: min((m for m in v if m[1] == s), key=v.index, default=None) for s in range(4)} for k, v in MOVES.items()}


def step(costs: list[int], given: int) -> list[int]:
    """Least costs of the states after one more turn."""
    out = [_FAR] * 4
    for s, c in enumerate(costs):
        if c < _FAR:
            for t, m in _BEST[s, given].items():
                if m and c + m[0] < out[t]:
                    out[t] = c + m[0]
    return out


def repair(given: list[int], first: int = START, last: int | None = None) -> tuple[int, list[tuple[int, int, str, int | None]]]:
    """Least cost from state first to state last (None: the cheapest, smallest), and each turn's (cost, state, action, inserted)."""
    tables = [[_FAR] * 4]
    tables[0][first] = 0
    for g in given:
        tables.append(step(tables[-1], g))
    if last is None:
        last = min(range(4), key=lambda s: (tables[-1][s], s))
    total, state, path = tables[-1][last], last, []
    for i in range(len(given) - 1, -1, -1):
        before = min((s for s in range(4) if tables[i][s] < _FAR and (m := _BEST[s, given[i]][state]) and tables[i][s] + m[0] == tables[i + 1][state]))
        path.append(_BEST[before, given[i]][state])
        state = before
    return total, path[::-1]


def _number(role: str | None) -> int:
    return NAMES.get((role or "").strip().lower(), 0)


def _number_of(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])
    return F.coalesce(F.element_at(names, F.lower(F.regexp_replace(role, r"^\s+|\s+$", ""))), F.lit(0))


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows as (key, rows), for keys of as many leading columns; a key's rows are bounded by how they were dealt."""
    key, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for r in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                if held and r[:keys] != key:
                    yield key, held
                    held = []
                key = r[:keys]
                held.append(r)
    if held:
        yield key, held


def _compose(ms: list[list[int]]) -> list[int]:
    """The (min, +) product of matrices in order, each 16 numbers."""
    out = ms[0]
    for m in ms[1:]:
        out = [min(min(out[4 * s + k] + m[4 * k + t] for k in range(4)), _FAR) for s in range(4) for t in range(4)]
    return out


def _borders(ms: list[list[int]], first: int, last: int | None) -> tuple[int, list[tuple[int, int]]]:
    """Least cost from first to last (None: the cheapest, smallest) through matrices in order, and the states before and after each."""
    tables = [[0 if s == first else _FAR for s in range(4)]]
    for m in ms:
        tables.append([min(min(tables[-1][s] + m[4 * s + t] for s in range(4)), _FAR) for t in range(4)])
    if last is None:
        last = min(range(4), key=lambda s: (tables[-1][s], s))
    state, out = last, []
    for i in range(len(ms) - 1, -1, -1):
        before = min(s for s in range(4) if tables[i][s] + ms[i][4 * s + state] == tables[i + 1][state])
        out.append((before, state))
        state = before
    return tables[-1][last], out[::-1]


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


_BLOCK = pa.schema([("conv", pa.string()), ("grp", pa.int64()), ("block", pa.int64()), ("matrix", pa.list_(pa.int64()))])
_GROUP = pa.schema([("conv", pa.string()), ("grp", pa.int64()), ("matrix", pa.list_(pa.int64()))])
_STATES = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _block_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, group, block, role numbers) as (conv, group, block, matrix)."""
    for batch in batches:
        out = []
        for conv, grp, block, roles in zip(*(c.to_pylist() for c in batch.columns)):
            rows = [[0 if s == t else _FAR for t in range(4)] for s in range(4)]
            for role in roles:
                rows = [step(r, role) for r in rows]
            out.append((conv, grp, block, [c for r in rows for c in r]))
        yield _columns(out, _BLOCK)


def _group_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, group, block, matrix), sorted, as (conv, group, matrix)."""
    for (conv, grp), rows in _runs(batches, 2):
        yield _columns([(conv, grp, _compose([r[3] for r in rows]))], _GROUP)


def _group_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, group, matrix), sorted, as (conv, group, state before, state after)."""
    for (conv,), rows in _runs(batches):
        yield _columns([(conv, r[1], *s) for r, s in zip(rows, _borders([r[2] for r in rows], START, None)[1])], _STATES)


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, group, block, matrix, state before the group, state after it), sorted, as (conv, block, state before, state after)."""
    for (conv, _), rows in _runs(batches, 2):
        yield _columns([(conv, r[2], *s) for r, s in zip(rows, _borders([r[3] for r in rows], rows[0][4], rows[0][5])[1])], _STATES)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: partition, whether this is its first conversation, and the place in the conversation here."""
    me, key, first, i = TaskContext.get().partitionId(), None, None, 0
    for batch in batches:
        firsts, places = [], []
        for conv in batch.column(0).to_pylist():
            if conv != key:
                key, i, first = conv, 0, first is None
            firsts.append(first)
            places.append(i)
            i += 1
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([me] * n, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(places, pa.int64()), *batch.columns], names=["part", "first", "i", *batch.schema.names])


#: What makes output rows of a block: (conversation, block, is it the last one, place of its first turn, its turns, their actions).
Emit = Callable[[str, int, bool, int, list[tuple], list[tuple]], list[tuple]]


def _gathered(blocks: Iterator[list[tuple]], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for rows in blocks:
        for r in rows:
            out.append(r)
            size += len(r[text])
            if len(out) >= 10_000 or size > 4 << 20:
                yield _columns(out, schema)
                out, size = [], 0
    if out:
        yield _columns(out, schema)


def _whole(emit: Emit, schema: pa.Schema, text: int):
    """Sorted rows (conv, turn, role number, text) of short conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered((emit(conv, 0, True, 0, [r[1:] for r in rows], repair([r[2] for r in rows])[1]) for (conv,), rows in _runs(batches)), schema, text)

    return run


def _in_blocks(emit: Emit, schema: pa.Schema, text: int, part_turns: int):
    """Rows (conv, block, end, state before, state after, turns) of long conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for at in range(batch.num_rows):
                    conv, block, end, first, last, turns = (c[at].as_py() for c in batch.columns)
                    rows = [(t["turn"], t["number"], t["text"]) for t in turns]
                    yield emit(conv, block, end, block * part_turns, rows, repair([r[1] for r in rows], first, last)[1])

        yield from _gathered(blocks(), schema, text)

    return run


def _repaired(turns: DataFrame, part_turns: int, emit: Emit, schema: pa.Schema, ddl: str, group_parts: int) -> DataFrame:
    """Output rows of emit for all conversations; schema's first column is the conversation and one is its text."""
    scratch = Scratch(turns.sparkSession, "chat")
    text = schema.get_field_index("text")
    # a tag keeps a null conv_id apart from any text
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    role = F.col("role").cast("string")
    rows = turns.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), _number_of(role).cast("int").alias("number"), F.col("text").cast("string").alias("text"))
    long = scratch.table(rows.groupBy("conv").agg(F.count("*").alias("turns")).where(F.col("turns") > part_turns))
    some_long = not long.isEmpty()
    short = rows.join(long, "conv", "left_anti") if some_long else rows
    out = short.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "turn", "number", "text").mapInArrow(_whole(emit, schema, text), ddl)
    if some_long:
        order = ["conv", "turn", "role", "text", "salt"]
        placed = rows.join(long.select("conv"), "conv", "left_semi").withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
        placed = scratch.table(placed.select("conv", "turn", "number", "text").mapInArrow(_numbered, "part int, first boolean, i long, conv string, turn long, number int, text string"))
        # a conversation lies in neighbouring partitions and is the first in all but one: a row for each partition at most
        counts = placed.groupBy("conv", "part", "first").agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("first and before is not null")
        placed = placed.join(F.broadcast(scratch.table(before.select("part", "first", "before"))), ["part", "first"], "left").withColumn("n", F.col("i") + F.coalesce("before", F.lit(0)))
        placed = placed.withColumn("block", F.floor(F.col("n") / part_turns))
        grp = F.floor(F.col("block") / group_parts).alias("grp")
        roles = placed.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("n", "number"))).alias("roles"))
        blocks = scratch.table(roles.select("conv", grp, "block", F.transform("roles", lambda r: r["number"]).alias("roles")).mapInArrow(_block_matrices, "conv string, grp long, block long, matrix array<long>"))
        groups = blocks.repartition("conv", "grp").sortWithinPartitions("conv", "grp", "block").mapInArrow(_group_matrices, "conv string, grp long, matrix array<long>")
        outer = groups.repartition("conv").sortWithinPartitions("conv", "grp").mapInArrow(_group_states, "conv string, at long, first int, last int")
        inner = blocks.join(outer.withColumnRenamed("at", "grp"), ["conv", "grp"]).select("conv", "grp", "block", "matrix", "first", "last").repartition("conv", "grp").sortWithinPartitions("conv", "grp", "block")
        states = scratch.table(inner.mapInArrow(_block_states, "conv string, at long, first int, last int").withColumnRenamed("at", "block"))
        whole = placed.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("n", "turn", "number", "text"))).alias("turns"))
        whole = whole.join(states, ["conv", "block"]).join(long.withColumnRenamed("turns", "of"), "conv")
        end = F.col("block") == F.floor((F.col("of") - 1) / part_turns)
        out = out.unionByName(whole.select("conv", "block", end.alias("end"), "first", "last", "turns").mapInArrow(_in_blocks(emit, schema, text, part_turns), ddl))
    named = F.when(F.col("conv") != "-", F.col("conv").substr(F.lit(2), F.length("conv"))).cast(turns.schema["conv_id"].dataType)
    return out.select(named.alias("conv_id"), *out.columns[1:])


_TURNS = pa.schema([("conv", pa.string()), ("n", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.int64())])
_PARTS = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("n_turns", pa.int64()), ("cost", pa.int64()), ("text", pa.string())])


def repaired_turns(turns: DataFrame, part_turns: int = PART_TURNS, group_parts: int = GROUP_PARTS) -> DataFrame:
    """Given turns with their repaired role: conv_id, n, turn, role, text, action, inserted, cost; one row per row of turns.

    turns: conv_id, turn, role, text; others are ignored.  Turns are taken in
    order of turn, role, text.  action: keep, relabel or merge (into the turn before); inserted: the role
    of an empty turn before this one, or null.  Of equally cheap repairs one is chosen by rule, part by part.

    Null text is empty, a null or
    unknown role is relabelled at a lower cost, a null turn comes first, turns
    without a conv_id form one conversation of their own; repeated rows are turns each; texts may be very long; an
    empty table gives an empty one.
    """

    def emit(conv, part, end, n, rows, path):
        return [(conv, n + i, turn, ROLES[state], text or "", action, ROLES.get(inserted), cost) for i, ((turn, _, text), (cost, state, action, inserted)) in enumerate(zip(rows, path))]

    return _repaired(turns, part_turns, emit, _TURNS, "conv string, n long, turn long, role string, text string, action string, inserted string, cost long", group_parts)


def render(turns: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>", part_turns: int = PART_TURNS, group_parts: int = GROUP_PARTS) -> DataFrame:
    """Rendered conversations: conv_id, part, n_turns, cost, text; n_turns counts the turns that begin in the part.

    Each given turn is rendered under its repaired role; a merged turn continues
    the one before after a blank line; inserted turns are empty.  Conversations of more
    than ``part_turns`` given turns come in numbered parts, to be joined in order;
    others are part 0.  The joined text ends every turn.

    Nulls, ties, repeated rows, very long texts, empty tables and further columns as in repaired_turns().
    """

    def emit(conv, part, end, n, rows, path):
        out, made = [], 0
        for i, ((_, _, text), (_, state, action, inserted)) in enumerate(zip(rows, path)):
            made += (action != "merge") + (inserted is not None)
            # what comes before closes the turn before, unless this one continues it
            out.append("" if n + i == 0 else "\n\n" if action == "merge" else closing + "\n")
            if inserted is not None:
                out.append(f"{opening}{ROLES[inserted]}\n{closing}\n")
            if action != "merge":
                out.append(f"{opening}{ROLES[state]}\n")
            out.append(text or "")
        return [(conv, part, made, sum(p[0] for p in path), "".join([*out, closing + "\n" if end else ""]))]

    return _repaired(turns, part_turns, emit, _PARTS, "conv string, part int, n_turns long, cost long, text string", group_parts)
