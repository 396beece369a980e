"""Searches, samples, memos, renamings, sweeps and the resumed census against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import evidence, graphs, samples, search, sweeps, trials
from millrace.plans import catalog_search as Q
from millrace.streaming import census

DIR = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=str)


# --- batch search ----------------------------------------------------------------------------------


def _searched(start, moves, scores, budget, batch, perfect, ties):
    at, score = start
    best, best_at, tried, seen, steps = score, at, 0, {at}, []
    reason = "exact" if score >= perfect else None
    while reason is None:
        pending = {}
        for place, target in moves.get(at, ()):
            if target not in seen:
                pending[target] = min(place, pending.get(target, place))
        chunk = sorted(pending, key=lambda t: (pending[t], t))[: min(batch, budget - tried)]
        seen |= set(chunk)
        tried += len(chunk)
        good = [(scores[t], -n, t) for n, t in enumerate(chunk) if t in scores and (scores[t] >= score if ties else scores[t] > score)]
        if good:
            score, _, to = max(good)
            steps.append((at, to, score))
            at = to
            if score > best:
                best, best_at = score, to
        reason = "exact" if best >= perfect else "budget spent" if tried >= budget else None if chunk else "nothing left"
    return (at, score, best, best_at, tried, len(steps), reason), steps


@pytest.mark.parametrize("ties", [False, True])
def test_batch_search(spark, ties):
    r = random.Random(8)
    start, moves, scores = {}, defaultdict(lambda: defaultdict(list)), defaultdict(dict)
    for u in range(60):
        n = r.randrange(1, 14)
        start[u] = (0, r.randrange(6))
        for s in range(n):
            for _ in range(r.randrange(5)):
                moves[u][s].append((r.randrange(4), r.randrange(n)))
        scores[u] = {t: r.randrange(10) for t in range(n) if r.random() < 0.8}
    a = spark.createDataFrame([(u, *s) for u, s in start.items()], "unit int, at int, score int")
    b = spark.createDataFrame([(u, s, p, t) for u in moves for s in moves[u] for p, t in moves[u][s]], "unit int, source int, place int, target int")
    c = spark.createDataFrame([(u, t, s, True) for u in scores for t, s in scores[u].items()] + [(u, 99, 9, False) for u in start], "unit int, target int, score int, valid boolean")
    b = b.union(spark.createDataFrame([(u, 0, 1, 99) for u in start], b.schema))  # better, but not valid
    want = {u: _searched(start[u], {s: [*m, *([(1, 99)] if s == 0 else [])] for s, m in (moves[u] | ({} if 0 in moves[u] else {0: []})).items()}, scores[u], 5, 3, 9, ties) for u in start}
    state, steps = search.batch_search(a, b, c, budget=5, batch=3, perfect=9, ties=ties)
    assert {x.unit: (x.at, x.score, x.best, x.best_at, x.tried, x.n_moves, x.reason) for x in state.collect()} == {u: w[0] for u, w in want.items()}
    assert rows(steps, "unit", "step", "source", "target", "score") == sorted(((u, n, *s) for u, w in want.items() for n, s in enumerate(w[1], 1)), key=str)
    assert {w[0][6] for w in want.values()} == {"exact", "budget spent", "nothing left"}
    assert any(w[0][4] == 5 for w in want.values())  # three, then a batch that the budget cuts to two


# --- climbing ----------------------------------------------------------------------------------------


def _after(order, i, j):
    rest = order[:i] + order[i + 1 :]
    return (*rest[:j], order[i], *rest[j:])


def test_block_moves_name_the_orders_that_they_give(spark):
    orders = {1: tuple("abcde"), 2: ("x",), 3: tuple("pq")}
    df = spark.createDataFrame([(u, b, p) for u, o in orders.items() for p, b in enumerate(o)], "unit int, block string, place int")
    got = search.block_moves(df).collect()
    assert {(m.unit, m.i, m.j) for m in got} == {(u, i, j) for u, o in orders.items() for i in range(len(o)) for j in range(len(o)) if i != j}
    names = defaultdict(set)
    for m in got:
        names[m.unit, _after(orders[m.unit], m.i, m.j)].add(m.digest)
    assert all(len(d) == 1 for d in names.values()) and len({min(d) for d in names.values()}) == len(names)
    flat = spark.createDataFrame([(n, b, p) for n, (_, o) in enumerate(names) for p, b in enumerate(o)], "unit int, block string, place int")
    whole = {x.unit: x.d for x in flat.groupBy("unit").agg(F.sum(search.hashed(F.col("block"), F.col("place"))).cast("string").alias("d")).collect()}
    assert [whole[n] for n in range(len(names))] == [min(d) for d in names.values()]
    one = search.moved(df, spark.createDataFrame([(1, 3, 0)], "unit int, i int, j int"))
    assert [x.block for x in one.where("unit = 1").orderBy("place").collect()] == list("dabce")


def test_a_move_that_loses_one_is_not_taken(spark):
    """Of three orders recorded the second gains two and loses one, the third gains one: only the third is taken."""
    df = spark.createDataFrame([(1, b, p) for p, b in enumerate("abc")], "unit int, block string, place int")
    moves = search.block_moves(df)
    digest = {(m.i, m.j): m.digest for m in moves.collect()}
    now = df.agg(F.sum(search.hashed(F.col("block"), F.col("place"))).cast("string")).first()[0]
    told = [(now, "u", True), (now, "v", False), (now, "w", False)]
    told += [(digest[0, 2], "u", False), (digest[0, 2], "v", True), (digest[0, 2], "w", True)]
    told += [(digest[2, 0], "u", True), (digest[2, 0], "v", True), (digest[2, 0], "w", False)]
    table = spark.createDataFrame([(1, *t) for t in told], "unit int, digest string, dependent string, exact boolean")
    blocks, steps = search.climb(df, search.recorded(table), budget=50, per_round=50)
    assert rows(steps, "step", "i", "j", "block", "total") == [(1, 2, 0, "c", 2)]
    assert [x.block for x in blocks.orderBy("place").collect()] == list("cab")
    _, none = search.climb(df, search.recorded(table.where(F.col("digest") != digest[2, 0])), budget=50, per_round=50)
    assert none.count() == 0


# --- additions -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [True, False])
def test_until_clean(spark, most):
    r = random.Random(9)
    repairs = {(u, a, f) for u in range(25) for a in range(6) for f in range(12) if r.random() < 0.25}
    faults = {(u, f) for u in range(27) for f in range(12) if r.random() < 0.7}
    want, ends = [], []
    for u in range(27):
        left = {f for v, f in faults if v == u}
        have = {a: {f for v, b, f in repairs if (v, b) == (u, a)} for a in range(6)}
        if not left:
            continue
        step = 0
        while any(h & left for h in have.values()):
            a = min((a for a in have if have[a] & left), key=lambda a: (-len(have[a] & left) if most else 0, a))
            n = len(have[a] & left)
            left -= have[a]
            step += 1
            want.append((u, step, a, n, len(left)))
        ends.append((u, len(left), "clean" if not left else "stuck"))
    steps, state = search.until_clean(spark.createDataFrame(sorted(repairs), "unit int, addition int, fault int"), spark.createDataFrame(sorted(faults), "unit int, fault int"), most)
    assert rows(steps, "unit", "step", "addition", "repaired", "left") == sorted(want, key=str)
    assert rows(state, "unit", "left", "reason") == sorted(ends, key=str)
    assert {e[2] for e in ends} == {"clean", "stuck"}


def test_rounds_of_additions_read_less_and_less(spark, monkeypatch):
    sizes = defaultdict(list)
    write = search.written

    def noted(df, name="table"):
        out = write(df, name)
        sizes[name].append(out.count())
        return out

    monkeypatch.setattr(search, "written", noted)
    r = random.Random(10)
    repairs = [(u, a, f) for u in range(10) for a in range(9) for f in range(20) if r.random() < 0.3]
    search.until_clean(spark.createDataFrame(repairs, "unit int, addition int, fault int"), spark.createDataFrame([(u, f) for u in range(10) for f in range(20)], "unit int, fault int"))
    assert len(sizes["edges"]) > 3 and all(a > b for a, b in zip(sizes["edges"], sizes["edges"][1:]))


# --- samples ---------------------------------------------------------------------------------------------


def test_sketches_merge(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"), "id", samples.drawn(F.col("id"), 5).alias("draw"))
    want = defaultdict(list)
    for x in df.collect():
        want[x.s].append((x.draw, x.id))
    want = {s: sorted(v)[:9] for s, v in want.items()}
    group = lambda out: {s: sorted((x.draw, x.id) for x in out if x.s == s) for s in want}
    whole = samples.sketch(df, ["s"], 9, ["draw", "id"])
    assert group(whole.collect()) == want
    parts = [samples.sketch(df.where(F.col("id") % 4 == k).repartition(5), ["s"], 9, ["draw", "id"]) for k in range(4)]
    assert group(samples.merge(parts, ["s"], 9, ["draw", "id"]).collect()) == want
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    assert samples.sketch(df.limit(0), ["s"], 9, ["draw", "id"]).count() == 0


# --- trials ------------------------------------------------------------------------------------------------


def test_a_second_run_measures_nothing(spark):
    candidates, dependents = Q.header_trials(spark, DIR)
    asked = []

    def evaluate(fresh):
        asked.append(fresh.count())
        return Q.measure_texts(fresh)

    none = spark.createDataFrame([], trials.MEMO)
    first, memo = trials.counterfactual(candidates, dependents, none, evaluate)
    n = dependents.join(candidates, "header").count()
    assert asked == [n]
    again, new = trials.counterfactual(candidates, dependents, memo, evaluate)
    assert asked == [n] and new.count() == 0
    assert rows(again) == rows(first) and {x.n_failed > 0 for x in first.collect()} == {True, False}
    trials.counterfactual(candidates.where("candidate is null or candidate < 3").union(candidates.where("candidate = 3").withColumn("content", F.lit("other"))), dependents, memo, evaluate)
    assert asked == [n, dependents.count()]


def test_a_header_that_was_never_measured_fails(spark):
    candidates, dependents = Q.header_trials(spark, DIR)
    with pytest.raises(Exception, match="no measurement as it is"):
        trials.counterfactual(candidates, dependents, spark.createDataFrame([], trials.MEMO), lambda fresh: Q.measure_texts(fresh).where(F.lit(False)))


# --- renamings --------------------------------------------------------------------------------------------


def test_cycles_of_one_to_nine(spark):
    r = random.Random(11)
    names = list(range(100, 145))
    r.shuffle(names)
    claims, rings, at = [], {}, 0
    for n in range(1, 10):
        ring = names[at : at + n]
        at += n
        first = ring.index(min(ring))
        ring = ring[first:] + ring[:first]
        for k, x in enumerate(ring):
            claims.append((x, ring[(k + 1) % n]))
            rings[x] = (ring[(k + 1) % n], min(ring), n, k)
    df = spark.createDataFrame(claims, "name int, other int")
    assert {x.name: (x.other, x.cycle, x.length, x.place) for x in graphs.cycles(df).collect()} == rings
    table = spark.createDataFrame([(n, f"v{n}", n % 7) for n in [*names, 1, 2]], "name int, v string, kept int")
    got = {x.name: (x.v, x.kept) for x in graphs.renamed(table, "name", ["v"], df).collect()}
    assert got == {n: (f"v{dict(claims).get(n, n)}", n % 7) for n in [*names, 1, 2]}


@pytest.mark.parametrize("claims", [[(1, 2), (2, 2)], [(1, 2), (2, 3)], [(1, 2), (1, 1), (2, 1)], [(None, 1), (1, None)]])
def test_what_is_no_renaming_is_refused(spark, claims):
    with pytest.raises(Exception, match="not a renaming"):
        graphs.cycles(spark.createDataFrame(claims, "name int, other int"))


def test_a_renaming_to_what_is_not_there_is_refused(spark):
    with pytest.raises(Exception, match="unknown name"):
        graphs.renamed(spark.createDataFrame([(1, "a")], "name int, v string"), "name", ["v"], spark.createDataFrame([(1, 2), (2, 1)], "name int, other int"))


# --- sweeps --------------------------------------------------------------------------------------------------


def test_sweeps_equal_frontiers_pair_by_pair(spark):
    r = random.Random(12)
    table = []
    for u in range(12):
        stream = [(r.choice("ab"), None if r.random() < 0.1 else r.random() < 0.4) for _ in range(8)]
        for run in sorted(r.sample(range(9), 5)):
            n = r.randrange(1, 9)
            table += [(u, run, k, *(stream[k] if r.random() < 0.95 else ("c", True))) for k in range(n)]
    df = spark.createDataFrame(table, "u int, run int, k int, v string, ok boolean")
    got = sweeps.consecutive(df, "u", "run", "k", ["v"], F.col("ok"))
    found = {(x.u, x.before, x.after): (x.n_before, x.n_after, x.n_accepted, x.at) for x in got.where("extends").collect()}
    want = {}
    for u in range(12):
        runs = sorted({t[1] for t in table if t[0] == u})
        for a, b in zip(runs, runs[1:]):
            one = evidence.frontier(df.where(f"u = {u} and run = {a}"), df.where(f"u = {u} and run = {b}"), "u", "k", ["v"], F.col("ok")).collect()
            want |= {(x.u, a, b): (x.n_before, x.n_after, x.n_accepted, x.at) for x in one}
    assert found == want and want
    assert len(got.collect()) == sum(len({t[1] for t in table if t[0] == u}) - 1 for u in range(12))
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


# --- census ---------------------------------------------------------------------------------------------------


def test_census_goes_on_where_it_stopped(spark):
    at, stream = Q.census(spark, DIR, stop_after=1)
    saved = spark.read.parquet(f"{at}/found").select("batch").distinct().count()
    assert saved == 2  # the second was saved, not committed
    found = Q.resumed(spark, at, stream)
    want = Counter()
    for x in Q.T(spark, DIR, "orders").collect():
        want[x.o_custkey, x.o_orderpriority] += 1
    got = Counter()
    for x in found.collect():
        got[x.unit, x.cause] += x.n
    assert got == want and found.select("batch").distinct().count() == 4
    census.run(stream, Q.analyse, f"{at}/found", f"{at}/checkpoint")
    assert found.count() == spark.read.parquet(f"{at}/found").count()
