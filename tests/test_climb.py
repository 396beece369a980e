"""Climbs over units as rows, against a plain search."""

import random

import pytest

from millrace.operators import search


def order(i, j):
    return (i * 7 + j * 3) % 11


def plain(blocks, constraints, budget, per_round):
    """Moves (step, i, j, block, total) of one unit."""
    held = lambda p: [p.index(a) < p.index(b) for a, b in constraints]
    now, seen, tried, out = list(blocks), {tuple(blocks)}, 0, []
    while tried < budget:
        tries = []
        for i, j in sorted(((i, j) for i in range(len(now)) for j in range(len(now)) if i != j), key=lambda m: (order(*m), m)):
            rest = now[:i] + now[i + 1 :]
            after = (*rest[:j], now[i], *rest[j:])
            if after not in seen and len(tries) < min(per_round, budget - tried):
                seen.add(after)
                tries.append((i, j, after))
        if not tries:
            break
        tried += len(tries)
        before = held(now)
        good = [(sum(h), i, j, after) for i, j, after in tries if sum(h := held(list(after))) > sum(before) and all(y for x, y in zip(before, h) if x)]
        if good:
            total, i, j, after = max(good, key=lambda g: g[0])
            out.append((len(out) + 1, i, j, now[i], total))
            now = list(after)
    return out


@pytest.mark.parametrize(("budget", "per_round"), [(24, 8), (5, 2), (60, 7)])
def test_climb_precedence_equals_a_plain_search(spark, budget, per_round):
    r = random.Random(budget)
    units = {u: r.sample(range(100), r.choice([1, 2, 3, 4, 5, 9, 17])) for u in range(120)}
    wanted = {u: [tuple(r.sample(b, 2)) for _ in range(r.randrange(len(b) + 2))] if len(b) > 1 else [] for u, b in units.items()}
    blocks = spark.createDataFrame([(u, x, p) for u, b in units.items() for p, x in enumerate(b)], "unit long, block long, place int")
    unknown = [(u, 1000, b[0], 500) for u, b in units.items()] + [(u, 1001, None, b[0]) for u, b in units.items()]  # of blocks that the unit lacks
    constraints = spark.createDataFrame([(u, d, a, b) for u, c in wanted.items() for d, (a, b) in enumerate(c)] + unknown, "unit long, dependent long, before long, after long")
    got = {}
    for x in search.climb_precedence(blocks, constraints, budget, per_round, order).collect():
        got.setdefault(x.unit, []).append((x.step, x.i, x.j, x.block, x.total))
    want = {u: moves for u, b in units.items() if (moves := plain(b, wanted[u], budget, per_round))}
    assert {u: sorted(m) for u, m in got.items()} == want
    assert max(map(len, want.values())) > 1


def test_first_moves():
    for n, most in ((2, 9), (3, 4), (7, 20), (7, 100)):
        seen, want = set(), []
        for i, j in sorted(((i, j) for i in range(n) for j in range(n) if i != j), key=lambda m: (order(*m), m)):
            rest = [k for k in range(n) if k != i]
            if (after := (*rest[:j], i, *rest[j:])) not in seen:
                seen.add(after)
                want.append((i, j))
        i, j = search.first_moves(n, most, order)
        assert list(zip(i.tolist(), j.tolist())) == want[:most]


def test_a_unit_of_many_blocks_needs_no_table_of_its_moves(spark, monkeypatch):
    monkeypatch.setattr(search, "written", lambda *_: pytest.fail("a table between the steps"))
    n = 3000  # nine million moves
    blocks = spark.range(n).selectExpr("0L as unit", "id as block", "cast(id as int) as place")
    constraints = spark.createDataFrame([(0, 8, 0), (0, 1, 2)], "unit long, before long, after long")
    # moves of block 8 come first, from the left on: the first already puts it before block 0
    got = search.climb_precedence(blocks, constraints, 24, 8, lambda i, j: (i != 8) * n + j)
    assert [tuple(x) for x in got.collect()] == [(0, 1, 8, 0, 8, 2)]
