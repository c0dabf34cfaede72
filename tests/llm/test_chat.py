import itertools
import random
import re

import pytest

from geoloom.llm import chat as C


def brute(roles):
    """Cheapest cost by trying every labelling, merge and insertion."""
    best = C.INF
    for labels in itertools.product((C.SYSTEM, C.USER, C.ASSISTANT), repeat=len(roles)):
        cost, states = 0, {C.BEGIN: 0}
        for r, x in zip(roles, labels):
            cost += 0 if r == x else C.RELABEL if r else C.RELABEL_UNKNOWN
            new = {}
            for s, c in states.items():
                options = [(C.MERGE, x)] if s == x else []
                options += [(C.INSERT * k, x) for k in range(3) if any(all(b in C.NEXT[a] for a, b in zip((s, *e, x), (*e, x))) for e in itertools.product((C.SYSTEM, C.USER, C.ASSISTANT), repeat=k))]
                for add, to in options:
                    new[to] = min(new.get(to, C.INF), c + add)
            states = new
        best = min([best, *(cost + c + C.end_cost(s) for s, c in states.items())])
    return best


def parse(rendered):
    return re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", rendered, re.S)


def legal(turns):
    s = C.BEGIN
    for role, _ in turns:
        if C.ROLES[role] not in C.NEXT[s]:
            return False
        s = C.ROLES[role]
    return s in C.FINAL


def test_costs_against_brute_force():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            states, cost = C.through([C.matrix(list(roles))])
            assert cost == brute(roles), roles


@pytest.mark.parametrize("segment,block", [(1, 4), (3, 2), (512, 4_096)])
def test_rendered_conversations(spark, segment, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(segment)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "User ", "tool", None]), f"t{c}.{i}") for c in range(60) for i in range(rng.randint(1, 9))]
    rows += [(None, i, "user", None) for i in range(4)] + [(99, 1, "user", "same")] * 5 + [(100, i, "user" if i % 2 else "assistant", "x") for i in range(2_000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    by = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] is not None, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((C.role_of(r), t or ""))
    out = C.format_chats(table, segment=segment).collect()
    assert len(out) == len(by)
    for r in out:
        want, turns = by[r.conv_id], parse(r.rendered)
        assert legal(turns) and len(turns) == r.n_rendered and r.n_turns == len(want)
        assert "".join(C.TURN.format(*x) for x in turns) == r.rendered
        assert r.cost == C.through([C.matrix([x for x, _ in want])])[1]
        assert [t for _, text in turns for t in text.split("\n") if t] == [t for _, t in want if t]


def test_whole_table_and_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    out = C.op9(spark, sf).collect()
    assert len(out) == turns.select("conv_id").distinct().count() and sum(r.n_turns for r in out) == turns.count()
    assert all(legal(parse(r.rendered)) for r in out)
    assert C.format_chats(turns.limit(0)).count() == 0


def test_blocks_of_segments_have_the_costs_of_the_whole():
    rng = random.Random(4)
    for _ in range(50):
        roles = [rng.randrange(4) for _ in range(rng.randint(2, 30))]
        parts = [roles[i : i + 3] for i in range(0, len(roles), 3)]
        assert C.product([C.matrix(p) for p in parts]) == C.matrix(roles)
        states, cost = C.through([C.matrix(p) for p in parts])
        assert sum(C.through([C.matrix(p)], a, b)[1] for p, a, b in zip(parts, states, states[1:])) + C.end_cost(states[-1]) == cost == C.through([C.matrix(roles)])[1]
