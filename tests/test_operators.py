"""Operators on small literal inputs."""

import random

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import align, bags, graphs, intervals, ordered, records, snapshots, votes

SNAP = "key long, unit string, score double, exact boolean, size long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_compare_and_worse(spark):
    before = spark.createDataFrame([(1, "u", 100.0, True, 10), (2, "u", 70.0, False, 10), (3, "u", 50.0, False, 10)], SNAP)
    after = spark.createDataFrame([(1, "u", 100.0, False, 10), (2, "u", 68.0, False, 10), (3, "u", 55.0, False, 10), (4, "u", 1.0, False, 10)], SNAP)
    got = {r.key: r.worse for r in snapshots.compare(before, after, "key").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_absent_after_is_worse_and_unsized_rejects(spark):
    before = spark.createDataFrame([(1, "u", 50.0, False, None), (2, "v", 50.0, False, 10), (3, "v", 10.0, False, 10)], SNAP)
    after = spark.createDataFrame([(2, "v", 40.0, False, 10), (3, "v", 20.0, False, 10)], SNAP)
    gate = {r.unit: r.reason for r in snapshots.net_gate(snapshots.compare(before, after, "key")).collect()}
    assert gate == {"u": "unsized", "v": "net not positive"}  # equality of the net to zero rejects


def test_merge_conflicts_and_deletions(spark):
    schema = "key string, place long, size long"
    base = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1), ("d", 4, 1)], schema)
    ours = spark.createDataFrame([("a", 9, 1), ("b", 2, 1), ("c", 7, 1), ("e", 5, 1)], schema)
    theirs = spark.createDataFrame([("a", 1, 1), ("c", 8, 1), ("d", 6, 1), ("e", 5, 1)], schema)
    got = {r.key: (r.status, r.place) for r in snapshots.three_way_merge(base, ours, theirs, "key", ["place", "size"]).collect()}
    assert got == {"a": ("ours", 9), "b": ("deleted", None), "c": ("conflict", None), "d": ("conflict", None), "e": ("both", 5)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SNAP)
    assert snapshots.net_gate(snapshots.compare(none, none, "key")).count() == 0
    assert bags.difference(none, none, ["unit"]).count() == 0
    assert votes.unanimous(none, "key", "unit").count() == 0
    assert intervals.merged(none.select("key", F.col("size").alias("s"), F.col("size").alias("e")), "key", "s", "e").count() == 0


def test_two_stage_cancel(spark):
    ours = spark.createDataFrame([("f", 1, 1), ("f", 1, 2), ("g", 2, 3), (None, 3, 4)], "name string, place long, ord long")
    theirs = spark.createDataFrame([("f", 1, 1), ("h", 2, 2), (None, 9, 3)], "name string, place long, ord long")
    a, b = bags.cancel(ours, theirs, ["name", "place"], "ord")
    assert rows(a.select("ord")) == [(2,), (4,)]
    assert rows(b.select("ord")) == [(3,)]


def test_pairs_overflow(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "key string, item long")
    b = spark.createDataFrame([("k", 7)], "key string, item long")
    assert rows(bags.pair(a, b, "key", "item").select("ours", "theirs")) == [(1, 7), (2, None), (3, None)]


def test_shared_base_layout(spark):
    ours = spark.createDataFrame([("a", "0,8,read"), ("only ours", "x")], "base string, member string")
    theirs = spark.createDataFrame([("a", "8,8,read"), ("only theirs", "x")], "base string, member string")
    got = bags.symmetric_difference(ours, theirs, "base", "member").collect()
    assert [(r.base, r.ours_only, r.theirs_only) for r in got] == [("a", 1, 1)]


def test_votes(spark):
    sites = spark.createDataFrame([("f", 1), ("f", 1), ("g", 2), ("h", 2), ("i", 3), ("i", 4)], "symbol string, place long")
    got = {r.symbol: r.proven for r in votes.unanimous(sites, "symbol", "place").collect()}
    assert got == {"f": True, "g": False, "h": False}
    tie = votes.weighted_vote(sites, "symbol", "place", F.lit(1)).collect()
    assert {r.symbol: r.winner for r in tie} == {"f": 1, "g": 2, "h": 2, "i": None}
    ranked = votes.rank_multivalue(spark.createDataFrame([(["Push", "Snap"], 10), (["Snap"], 50), (["Push"], 5)], "c array<string>, size long"), F.col("c"), "size")
    assert rows(ranked) == [("Push", 2, 15), ("Snap", 2, 60)]


def test_exact_sets(spark):
    data = [("always", p, True) for p in range(4)] + [("witness", p, p % 2 == 0) for p in range(4)] + [("locked", p, p == 3) for p in range(4)] + [("never", p, False) for p in range(4)]
    got = votes.exact_sets(spark.createDataFrame(data, "symbol string, phase long, exact boolean"), "symbol", "phase", F.col("exact"), F.col("phase") == 0, 4)
    assert all(r.symbol == r.kind for r in got.collect())


def test_ranges_lost_and_gained(spark):
    make = lambda *r: intervals.merged(spark.createDataFrame([("k", a, a + n) for a, n in r], "key string, s long, e long"), "key", "s", "e")
    got = intervals.lost_and_gained(make((0x1000, 60), (0x2000, 8)), make((0xFA0, 284),), "key").collect()[0]
    assert (got.lost, got.gained) == (8, 224)
    got = intervals.lost_and_gained(make((0x1000, 4), (0x2000, 4)), make((0x1000, 4), (0x3000, 4)), "key").collect()[0]
    assert (got.lost, got.gained) == (4, 4)


def test_owner_is_null_unless_one(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 15.0), (3, 99.0)], "k long, x double")
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", 10.0, 20.0), ("c", 14.0, 16.0)], "o string, lo double, hi double")
    assert rows(intervals.owners(points, "x", "k", ranges, "lo", "hi", "o").select("k", "owner", "n_owners")) == [(1, "a", 1), (2, None, 2), (3, None, 0)]


def test_ordered(spark):
    found = ordered.islands(spark.createDataFrame([("u", n) for n in (3, 4, 5, 9)], "k string, n long"), "k", F.col("n"))
    assert ordered.spans_text(found, "k").first().spans == "3-5, 9"
    gaps = ordered.continuity(spark.createDataFrame([("u", n) for n in (0, 1, 3)], "k string, n long"), "k", "n")
    assert rows(gaps) == [("u", 3, 2)]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "source long, target long")
    assert rows(graphs.closure(e, spark.createDataFrame([(1,)], "node long"))) == [(1, 0), (2, 1), (3, 2)]
    assert rows(graphs.components(e, spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 7)], "node long"))) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7)]
    chains = graphs.single_chains(spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (7, 8), (8, 7)], "source long, target long"), spark.createDataFrame([(1,), (4,), (7,)], "node long"))
    assert {r.node: (r.end, r.why) for r in chains.collect()} == {1: (3, "end"), 4: (4, "ambiguous"), 7: (8, "cycle")}


def test_single_chains_have_no_cap(spark):
    r = random.Random(6)
    edges = [(n, n + 1) for n in range(500)] + [(n, n + 1) for n in range(1000, 1300)] + [(1300, 1200)]
    edges += [(n, r.randrange(2000, 2060)) for n in range(2000, 2060)] + [(2000, 2050), (2001, 2051)]
    targets = {}
    for s, t in edges:
        targets.setdefault(s, set()).add(t)

    def follow(n):
        path = [n]
        while True:
            on = targets.get(path[-1], ())
            if len(on) != 1:
                return path[-1], len(path) - 1, "ambiguous" if on else "end"
            if (to := min(on)) in path:
                return path[-1], len(path) - 1, "cycle"
            path.append(to)

    start = [0, 250, 499, 500, 900, 1000, 1250, 1300, *range(2000, 2060)]
    got = graphs.single_chains(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(n,) for n in start], "node long"))
    want = {n: follow(n) for n in start}
    assert {r.node: (r.end, r.length, r.why) for r in got.collect()} == want
    assert {w[2] for w in want.values()} == {"end", "ambiguous", "cycle"}


def test_rewrites(spark):
    got = rows(align.rewrites(spark.createDataFrame([(1, "a\nb"), (2, None), (3, "x")], "k long, t string"), "k", "t"))
    assert got == [(1, "join", 0, "a b"), (1, "swap", 0, "b\na")]


def test_scalars(spark):
    one = spark.createDataFrame([("0xffffffffffffffff", "17", "zz", "line 12: x", "error: no member foo in Bar")], "a string, b string, c string, d string, e string")
    got = one.select(X.address(F.col("a")), X.address(F.col("b")), X.address(F.col("c")), X.line_of(F.col("d")), X.cause(F.col("e"), [("no member ([a-z]+)", "member {1}")]), X.signed(F.lit(4294967295))).first()
    assert [int(got[0]), int(got[1]), got[2], got[3], got[4], got[5]] == [2**64 - 1, 17, None, 12, "member foo", -1]
    got = spark.range(1).select(X.distance(F.lit(5), F.array(F.lit(1), F.lit(7))), X.distance(F.lit(5), F.array().cast("array<int>")), X.callees(F.lit("if (foo(bar(1)) && foo(2)) // baz()"), ["if"]), X.relative(F.lit("/r//src/./a.cpp"), "/r"), X.shortest(F.lit(99.1))).first()
    assert list(got) == [2, 0, ["foo", "bar"], "src/a.cpp", 99.1]


def test_group_precedence(spark):
    f = lambda kinds, signals: X.group_of(F.array(*map(F.lit, kinds)).cast("array<string>"), F.array(*map(F.lit, signals)).cast("array<string>"), ["s"], ["n"])
    assert list(spark.range(1).select(f(["n", "s"], []), f(["n"], []), f(["n"], ["x"]), f(["z"], []), f([], [])).first()) == ["source", "no source", "source", "other", "other"]


def test_search_steps(spark):
    e = spark.createDataFrame([("u", 1, 5.0, True), ("u", 2, 9.0, False), ("u", 3, 7.0, True), ("u", 4, 6.0, True)], "unit string, ord long, score double, ok boolean")
    assert rows(records.search_steps(e, "unit", ["ord"], "score", F.col("ok")).select("ord", "step")) == [(1, 1), (3, 2)]
