"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant. Each input turn is kept, relabelled,
or merged into the turn before it, and empty turns may be inserted before it or
at the end; COSTS prices each, and the cheapest repair is rendered.

The automaton has four states, so what a stretch of turns does is a 4 x 4 table
of least costs. Turns are sorted into ranges of (conv_id, turn); a range reports
the tables of its first and last conversation only, the driver joins those of
conversations that cross ranges (two small tables for each range), and each
stretch is then repaired in its own task between the states that the join gave
it. A conversation of any length is thus spread over many tasks.

Defined cases: null and unknown roles must be relabelled or merged; null texts
are empty; turns that tie on (conv_id, turn) follow role and text; repeated rows
are turns of their own; null conversation ids are one conversation, null turns
come first; ids and turns are whole numbers, also as text (other text raises);
texts of any length are kept whole; other columns are ignored; among repairs of equal cost the first in
the order keep, merge, relabel, fewer insertions is taken stretch by stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, and after a turn of each role.
START, STATES = 0, 4
#: Which roles may follow in each state, and where a conversation may end.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = 3
COSTS = {"keep": 0, "merge": 1, "relabel": 2, "insert": 2, "merge_other": 3}
_FAR = 10 ** 9


def _insertions() -> list[list[tuple[int, ...] | None]]:
    """Shortest runs of inserted turns from state to state (empty turns are never of the system)."""
    best: list[list[tuple[int, ...] | None]] = [[None] * STATES for _ in range(STATES)]
    for s in range(STATES):
        best[s][s] = ()
        todo = [s]
        for t in todo:
            for r in NEXT[t]:
                if r != 1 and best[s][r] is None:
                    best[s][r] = (*best[s][t], r)
                    todo.append(r)
    return best


INSERTIONS = _insertions()


def _step(role: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """For a turn of this role (0: unknown) the cheapest (cost, action, insertions before it) from state to state."""
    out = [[(_FAR, "", ())] * STATES for _ in range(STATES)]
    for s, mid in product(range(STATES), repeat=2):
        ins = INSERTIONS[s][mid]
        if ins is None:
            continue
        base = COSTS["insert"] * len(ins)
        choices = []
        for r in NEXT[mid]:
            choices.append((base + COSTS["keep" if r == role else "relabel"], "keep" if r == role else "relabel", r))
        if mid != START and not ins:  # what was inserted is empty: merging into it would be a relabelling
            choices.append((COSTS["merge" if mid == role else "merge_other"], "merge", mid))
        for cost, action, to in choices:
            rank = ("keep", "merge", "relabel").index(action), len(ins)
            old = out[s][to]
            if (cost, *rank) < (old[0], ("keep", "merge", "relabel", "").index(old[1]), len(old[2])):
                out[s][to] = (cost, action, ins)
    return out


STEPS = [_step(r) for r in range(STATES)]


def role_number(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else 0


def costs_from(roles: list[int], entry: int) -> tuple[list[int], list[list[int]]]:
    """Least costs to be in each state after these turns, and the states before each turn on the way."""
    now = [_FAR] * STATES
    now[entry] = 0
    back = []
    for r in roles:
        step = STEPS[r]
        new, via = [_FAR] * STATES, [0] * STATES
        for s in range(STATES):
            if now[s] < _FAR:
                for t in range(STATES):
                    c = now[s] + step[s][t][0]
                    if c < new[t]:
                        new[t], via[t] = c, s
        now = new
        back.append(via)
    return now, back


def ending(state: int) -> tuple[int, ...]:
    """Turns inserted at the end of a conversation in this state."""
    return INSERTIONS[state][FINAL] or ()


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[int, list[tuple[str, int, tuple[int, ...]]], tuple[int, ...]]:
    """Cost, and for each turn its action, new role and insertions before it, and the insertions at the end.

    With ``leave`` the turns are a stretch that has to end in that state.
    """
    now, back = costs_from(roles, entry)
    if leave is None:
        total = [c + COSTS["insert"] * len(ending(s)) if INSERTIONS[s][FINAL] is not None else _FAR for s, c in enumerate(now)]
        state = total.index(min(total))
        cost, end = total[state], ending(state)
    else:
        state, cost, end = leave, now[leave], ()
    out = []
    for r, via in zip(reversed(roles), reversed(back), strict=True):
        s = via[state]
        _, action, ins = STEPS[r][s][state]
        out.append((action, state, ins))
        state = s
    return cost, out[::-1], end


def rendered(role: int, text: str, action: str, before: tuple[int, ...], first: bool) -> str:
    """The turn's part of the conversation; parts in order, with a closing mark at the end, are the whole."""
    opened = [f"<|{ROLES[r - 1]}|>\n" for r in before]
    close = "" if first else "\n<|end|>\n"
    if action == "merge":
        return "\n\n" + text
    return close + "".join(o + "\n<|end|>\n" for o in opened) + f"<|{ROLES[role - 1]}|>\n{text}"


def _sorted(conversations: DataFrame) -> DataFrame:
    """Turns in order with a number for each conversation's stretch in a range, and the tables of the outer ones."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        run, pos, last, first_run = part, 0, None, None
        tables: list[list[int]] | None = None
        names = ["conv_id", "turn", "role", "text", "run", "pos", "table"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

        def forward(old: list[list[int]] | None, r: int) -> list[list[int]]:
            old = old or [[0 if s == t else _FAR for t in range(STATES)] for s in range(STATES)]
            return [[min(_FAR, min(row[m] + STEPS[r][m][t][0] for m in range(STATES))) for t in range(STATES)] for row in old]

        def told(conv, at: int, found: list[list[int]]) -> pa.RecordBatch:
            """A row without position carries the table of a whole stretch."""
            row = [conv, None, None, None, at, None, [c for x in found for c in x]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        started = False
        for b in batches:
            runs, places = [], []
            for conv, role in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not started or conv != last:
                    if started:
                        if first_run == run:
                            yield told(last, run, tables)
                        run, pos, tables = run + 1, 0, None
                    else:
                        first_run, started = run, True
                    last = conv
                tables = forward(tables, role_number(role))
                runs.append(run)
                places.append(pos)
                pos += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, pa.int64()), pa.array(places, pa.int64()), pa.nulls(len(runs), kinds[-1])], names=names)
        if started:
            yield told(last, run, tables)

    order = ["conv_id", "turn", "role", "text"]
    x = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    x = x.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return materialise(x.mapInArrow(of, "conv_id bigint, turn bigint, role string, text string, run bigint, pos bigint, table array<int>"), "turns")


def joined(outer: list[tuple[int | None, int, list[int]]]) -> dict[int, tuple[int, int | None]]:
    """States in which stretches of conversations that cross ranges begin and end (None: the conversation ends)."""
    by: dict[int | None, list[tuple[int, list[int]]]] = {}
    for conv, run, found in outer:
        by.setdefault(conv, []).append((run, found))
    out: dict[int, tuple[int, int | None]] = {}
    for runs in by.values():
        if len(runs) == 1:
            continue
        runs.sort()
        now, back = [_FAR] * STATES, []
        now[START] = 0
        for _, found in runs:
            choice = [min(range(STATES), key=lambda s: now[s] + found[s * STATES + t]) for t in range(STATES)]
            back.append(choice)
            now = [min(_FAR, now[choice[t]] + found[choice[t] * STATES + t]) for t in range(STATES)]
        total = [c + COSTS["insert"] * len(ending(s)) if INSERTIONS[s][FINAL] is not None else _FAR for s, c in enumerate(now)]
        state = total.index(min(total))
        for k in range(len(runs) - 1, -1, -1):
            entry = back[k][state]
            out[runs[k][0]] = (entry, state)
            state = entry
    return out


def repair_roles(conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, role, action, new_role, inserted (roles before it), cost, segment.

    The segments of a conversation in order (``conv_id``, ``turn``; ties by
    role and text) are the rendered conversation; the last one also holds the
    turns inserted at the end.
    """
    turns = _sorted(conversations)
    # two rows for each range at most
    outer = [(r.conv_id, r.run, r.table) for r in turns.where("pos IS NULL").select("conv_id", "run", "table").collect()]
    sent = turns.sparkSession.sparkContext.broadcast((joined(outer), {run for _, run, _ in outer}))
    last_runs: dict[int | None, int] = {}
    for conv, run, _ in outer:
        last_runs[conv] = max(run, last_runs.get(conv, run))
    finals = turns.sparkSession.sparkContext.broadcast(set(last_runs.values()))
    names = ["conv_id", "turn", "role", "action", "new_role", "inserted", "cost", "segment"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (states, outer_runs), final = sent.value, finals.value
        held: list[tuple] = []

        def done() -> list[tuple]:
            run = held[0][4]
            entry, leave = states.get(run, (START, None))
            ends = run not in outer_runs or run in final
            roles = [role_number(h[2]) for h in held]
            _, plan, _ = repair(roles, entry, leave)
            end = ending(plan[-1][1]) if ends else ()
            state, rows = entry, []
            for k, (h, r, (action, to, ins)) in enumerate(zip(held, roles, plan, strict=True)):
                cost = STEPS[r][state][to][0]
                segment = rendered(to, h[3] or "", action, ins, state == START)
                if k == len(held) - 1 and ends:
                    cost += COSTS["insert"] * len(end)
                    segment += "\n<|end|>\n" + "".join(f"<|{ROLES[x - 1]}|>\n\n<|end|>\n" for x in end)
                rows.append((h[0], h[1], h[2], action, ROLES[to - 1], ",".join(ROLES[x - 1] for x in ins), cost, segment))
                state = to
            return rows

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[4] != held[0][4]:
                    out += done()
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done(), strict=True), kinds, strict=True)], names=names)

    rows = turns.where("pos IS NOT NULL").drop("table").repartition("run").sortWithinPartitions("run", "pos").select("conv_id", "turn", "role", "text", "run")
    return rows.mapInArrow(of, "conv_id bigint, turn bigint, role string, action string, new_role string, inserted string, cost int, segment string")


def op4_chat_repair(spark, sf_dir):
    return repair_roles(table(spark, sf_dir, "conversations"))
