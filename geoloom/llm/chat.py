"""Chat formatting with minimum-cost role repair.

The automaton of legal turns: an optional system turn, then user and assistant in turn, user first. Every input turn is
kept under its role, merged into the turn before, relabelled, or preceded by empty turns; a dynamic programme over the
automaton's states finds the cheapest repair of the whole conversation, which is then rendered.

The costs of a run of turns are a matrix over the states, and those of runs one after the other their product in
(min, +). So conversations are ordered by range and cut into segments of a bounded number of turns, each reduced to its
matrix; so are blocks of a bounded number of segments. The blocks of a conversation give the states between them, each
block those between its segments, and each segment is repaired between its two states. So a conversation that holds a
third of all turns is spread over many tasks; it meets in one place only as a matrix for each block, and at the very end
as the one text that is asked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialised

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
#: Legal successions.
NEXT = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# The costs of a repair. An unknown role may be relabelled for less.
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 3, 1, 4
#: Conversations may end with these; another end costs the empty turns that are missing.
FINAL = (USER, ASSISTANT)
SEGMENT, BLOCK = 512, 4_096
#: By so many signs of tied turns' texts ranges are cut; within a range whole texts are compared.
RANGE_SIGNS = 64
INF = 10**15
#: Rendered as <|role|>, the text and <|end|>, each on a line.
TURN = "<|{}|>\n{}\n<|end|>\n"


def role_of(role: str | None) -> int:
    """The state of a role, in any case and with white space around; 0 for an unknown one."""
    return ROLES.get((role or "").strip().lower(), 0)


def _moves() -> dict[int, list[tuple[int, int, tuple[int, ...], bool]]]:
    """For each role (0: unknown): (from, to, empty turns before, merged), with its cost as the last, cheapest first
    by from and to; of equal costs fewer changes come first."""
    out = {}
    for role in range(4):
        best = {}
        for a in range(4):
            for b in (SYSTEM, USER, ASSISTANT):
                label = 0 if b == role else RELABEL if role else RELABEL_UNKNOWN
                if a == b:
                    best[a, b] = (label + MERGE, (), True)
                for empty in ((), (USER,), (ASSISTANT,), (USER, ASSISTANT), (ASSISTANT, USER)):
                    path = (a, *empty, b)
                    if all(y in NEXT[x] for x, y in zip(path, path[1:], strict=False)):
                        cost = label + INSERT * len(empty)
                        if (a, b) not in best or cost < best[a, b][0]:
                            best[a, b] = (cost, empty, False)
        out[role] = [(a, b, cost, empty, merged) for (a, b), (cost, empty, merged) in sorted(best.items())]
    return out


MOVES = _moves()


def end_cost(state: int) -> int:
    """Of ending a conversation in a state: an empty user turn where there is only a system turn or nothing."""
    return 0 if state in FINAL else INSERT


def forward(roles: list[int], start: list[int]) -> list[list[int]]:
    """Least costs of each state after each turn, from the costs of the states before the first."""
    rows = [start]
    for r in roles:
        now, new = rows[-1], [INF] * 4
        for a, b, cost, _, _ in MOVES[r]:
            if now[a] + cost < new[b]:
                new[b] = now[a] + cost
        rows.append(new)
    return rows


def matrix(roles: list[int]) -> list[int]:
    """Least costs from each state to each over a segment, row by row."""
    return [c for s in range(4) for c in forward(roles, [0 if x == s else INF for x in range(4)])[-1]]


def repair(roles: list[int], start: int, end: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """The cheapest moves (state, empty turns before, merged) from state to state; of equals the move from the
    smallest state, last turn first."""
    rows = forward(roles, [0 if x == start else INF for x in range(4)])
    out = []
    for i in range(len(roles) - 1, -1, -1):
        a, _, _, empty, merged = next(m for m in MOVES[roles[i]] if m[1] == end and rows[i][m[0]] + m[2] == rows[i + 1][end] and rows[i][m[0]] < INF)
        out.append((end, empty, merged))
        end = a
    return out[::-1]


def product(matrices: list[list[int]]) -> list[int]:
    """Least costs from each state to each over segments one after the other."""
    out = [0 if a == b else INF for a in range(4) for b in range(4)]
    for m in matrices:
        out = [min(INF, *(out[4 * a + k] + m[4 * k + b] for k in range(4))) for a in range(4) for b in range(4)]
    return out


def through(matrices: list[list[int]], start: int = BEGIN, end: int | None = None) -> tuple[list[int], int]:
    """The states between segments, from ``start`` on, and the total cost. Without an end the cheapest is taken, with
    what ending there costs."""
    rows = [[0 if s == start else INF for s in range(4)]]
    for m in matrices:
        now = rows[-1]
        rows.append([min(INF, *(now[a] + m[4 * a + b] for a in range(4))) for b in range(4)])
    total, end = min((rows[-1][s] + end_cost(s), s) for s in range(4)) if end is None else (rows[-1][end], end)
    states = [end]
    for i in range(len(matrices) - 1, -1, -1):
        states.append(next(a for a in range(4) if rows[i][a] < INF and rows[i][a] + matrices[i][4 * a + states[-1]] == rows[i + 1][states[-1]]))
    return states[::-1], total


def render(texts: list[str], moves: list[tuple[int, tuple[int, ...], bool]]) -> tuple[str, str, int]:
    """What a segment adds to the turn before it (texts of merged turns at its beginning, each on a new line), its own
    turns, and their number. The last turn is left open, as the next segment may add to it."""
    lead, out, n = [], [], 0
    for text, (state, empty, merged) in zip(texts, moves, strict=True):
        if merged:
            (out if n else lead).append("\n" + text)
            continue
        for e in empty:
            out.append(("\n<|end|>\n" if n else "") + f"<|{NAMES[e]}|>\n")
            n += 1
        out.append(("\n<|end|>\n" if n else "") + f"<|{NAMES[state]}|>\n{text}")
        n += 1
    return "".join(lead), "".join(out), n


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conversation, n_turns, n_rendered, cost, rendered) of each conversation.

    Turns are ordered by number, role and text, each with nulls first, so that repeated and tied turns have an order.
    A null text is an empty one; a null or unknown role has to be relabelled; rows without a conversation are one of
    their own. Other columns aren't read.
    """
    kind = turns.schema[conversation].dataType.simpleString()
    source = turns.select(F.col(conversation).alias("c"), F.col(turn).cast("long").alias("n"), F.col(role).cast("string").alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    # by range, so that a long conversation is dealt over as many tasks as its share of the rows asks for
    ordered = source.repartitionByRange("c", "n", "r", F.substring("t", 1, RANGE_SIGNS)).sortWithinPartitions("c", "n", "r", "t")

    def cut(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        held, key = [], None

        def segment_row():
            nonlocal place
            place += 1
            roles = [r for r, _ in held]
            return ([key], [part], [place], [roles], [[t for _, t in held]], [matrix(roles)])

        names, rows = ["c", "part", "place", "roles", "texts", "costs"], []
        for batch in batches:
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and (c != key or len(held) == segment):
                    rows.append(segment_row())
                    held = []
                key = c
                held.append((role_of(r), t))
            if rows:
                yield record(rows, batch.schema.field(0).type, names)
                rows = []
            kind_c = batch.schema.field(0).type
        if held:
            yield record([segment_row()], kind_c, names)

    def record(rows, kind_c, names):
        flat = [[x[0] for x in col] for col in zip(*rows, strict=True)]
        kinds = [kind_c, pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(flat, kinds, strict=True)], names)

    segments = materialised(ordered.mapInArrow(cut, f"c {kind}, part int, place int, roles array<int>, texts array<string>, costs array<long>"))
    block = BLOCK
    steps = segments.select("c", "part", "place", F.floor(F.col("place") / block).cast("int").alias("block"), "costs", F.size("roles").cast("long").alias("n"))

    def runs_of(batches, names):
        """The rows of the named columns, run by run of equal (c, part, block), which come one after the other."""
        key, held = None, []
        for batch in batches:
            for r in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if held and r[:3] != key:
                    yield key, held
                    held = []
                key = r[:3]
                held.append(r[3:])
        if held:
            yield key, held

    def reduced(batches):
        # segments are kept as they were made, in order of their conversation and place
        rows = [(*key, product([c for c, _ in held]), sum(n for _, n in held)) for key, held in runs_of(batches, ["c", "part", "block", "costs", "n"])]
        kinds = [segment_kind, pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        for i in range(0, len(rows), 2_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows[i : i + 2_000]], k) for x, k in enumerate(kinds)], ["c", "part", "block", "costs", "n"])

    segment_kind = to_arrow_type(segments.schema["c"].dataType)
    blocks = materialised(steps.mapInArrow(reduced, f"c {kind}, part int, block int, costs array<long>, n long"))

    def combine(batches):
        for batch in batches:
            states, costs = [], []
            for runs in batch.column("runs").to_pylist():
                s, total = through([x["costs"] for x in runs])
                states.append([{"part": x["part"], "block": x["block"], "a": a, "b": b, "last": i + 1 == len(runs)} for i, (x, a, b) in enumerate(zip(runs, s, s[1:], strict=False))])
                costs.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array(costs, pa.int64()), pa.array(states, pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("last", pa.bool_())])))], ["c", "n", "cost", "runs"])

    # a conversation's blocks: one row of 16 numbers for each BLOCK * SEGMENT turns, and for each range it reaches into
    gathered = blocks.groupBy("c").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "block", "costs"))).alias("runs"))
    solved = materialised(gathered.mapInArrow(combine, f"c {kind}, n long, cost long, runs array<struct<part:int,block:int,a:int,b:int,last:boolean>>"))
    ends = solved.select(F.col("c").alias("k"), F.inline("runs"))

    def between(batches):
        names, kinds, rows = ["part", "place", "a", "b", "last"], [pa.int32()] * 4 + [pa.bool_()], []

        def record():
            return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], k) for x, k in enumerate(kinds)], names)

        for (_, part, _), held in runs_of(batches, ["c", "part", "block", "place", "costs", "a", "b", "last"]):
            _, _, a, b, last = held[0]
            s = through([x[1] for x in held], a, b)[0]
            rows += [(part, x[0], s[i], s[i + 1], last and i + 1 == len(held)) for i, x in enumerate(held)]
            if len(rows) >= 2_000:
                yield record()
                rows = []
        if rows:
            yield record()

    keys = ["c", "part", "block"]
    ends = ends.withColumnsRenamed({"part": "e_part", "block": "e_block"})
    found = steps.join(ends, F.col("c").eqNullSafe(F.col("k")) & (F.col("part") == F.col("e_part")) & (F.col("block") == F.col("e_block")))
    # a block's segments together and in order: at most BLOCK rows
    plan = found.select(*keys, "place", "costs", "a", "b", "last").repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(between, "part int, place int, a int, b int, last boolean")

    def repaired(batches):
        for batch in batches:
            made = []
            for roles, texts, a, b, last in zip(*(batch.column(x).to_pylist() for x in ("roles", "texts", "a", "b", "last")), strict=True):
                lead, own, n = render(texts, repair(roles, a, b))
                if last and b not in FINAL:
                    own, n = own + ("\n<|end|>\n" if n or b != BEGIN else "") + f"<|{NAMES[USER]}|>\n", n + 1
                made.append((lead, own, n))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("part"), batch.column("place"), *[pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32()))]], ["c", "part", "place", "lead", "own", "m"])

    parts = segments.join(plan, ["part", "place"]).select("c", "part", "place", "roles", "texts", "a", "b", "last")
    texts = parts.mapInArrow(repaired, f"c {kind}, part int, place int, lead string, own string, m int")
    whole = texts.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "place", "lead", "own", "m"))).alias("x"), F.sum("m").cast("long").alias("m"))
    # a turn is closed where the next begins, in the same segment or a later one
    joined = F.array_join(F.transform("x", lambda x, i: F.concat(x["lead"], F.when((x["m"] > 0) & (i > 0), "\n<|end|>\n").otherwise(""), x["own"])), "")
    out = whole.select(F.col("c").alias("k"), "m", F.concat(joined, F.lit("\n<|end|>\n")).alias("rendered"))
    return solved.join(out, solved["c"].eqNullSafe(out["k"])).select(F.col("c").alias(conversation), F.col("n").alias("n_turns"), F.col("m").alias("n_rendered"), "cost", "rendered")


def op9(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
