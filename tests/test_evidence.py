"""Evidence, inventories and findings on literal rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as X
from millrace.operators import bags, evidence, findings, graphs, intervals, inventories, lookups, votes


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def inventory(spark, *, extra=()):
    listed = spark.createDataFrame([(0x1000, 20, True), (0x2000, 30, False), *extra], "key long, size long, exact boolean")
    found = spark.createDataFrame([(0x1000, 20), (0x9000, 7), (None, 5)], "key long, size long")
    return listed, found


def test_reconcile_counts_missing_overlap_and_untracked(spark):
    listed, found = inventory(spark, extra=[(0x3000, 8, False)])
    parts = inventories.reconcile(listed, found.union(spark.createDataFrame([(0x3000, 9)], "key long, size long")), "key")
    assert rows(parts) == [("classified", 1, 8), ("missing", 1, 30), ("overlap", 1, 20), ("untracked", 2, 12)]


def test_balance_holds_and_breaks(spark):
    totals = spark.createDataFrame([(60, 20)], "total long, matched long")
    unclaimed = spark.createDataFrame([(10,)], "bytes long")
    listed, found = inventory(spark)
    good = inventories.balance(inventories.reconcile(listed, found, "key"), totals, unclaimed)
    assert rows(good) == [(40, 40, 0)] and inventories.require_balance(good).count() == 1
    bad = inventories.balance(inventories.reconcile(listed.where("exact"), found, "key"), totals, unclaimed)
    assert rows(bad) == [(40, 10, 30)]
    with pytest.raises(Exception, match="do not reconcile"):
        inventories.require_balance(bad).collect()


def test_registered_balance_depends_on_every_order(spark, tmp_path):
    from millrace.plans import catalog, catalog_findings  # noqa: F401

    def world(name, orders):
        at = tmp_path / name
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(at / "orders.parquet"))
        spark.createDataFrame([(1, 0), (2, 1)], "c_custkey long, c_nationkey int").write.parquet(str(at / "customer.parquet"))
        spark.createDataFrame([(1, 5.0, "R"), (9, 2.0, "R"), (2, 1.0, "N")], "l_orderkey long, l_quantity double, l_returnflag string").write.parquet(str(at / "lineitem.parquet"))
        return {r.part: (r.n, r.bytes) for r in catalog.QUERIES["reconcile_parts"](spark, str(at)).collect()}, rows(catalog.QUERIES["reconcile_balance"](spark, str(at)))

    orders = [(1, 1, "O", 30.5), (2, 2, "F", 20.0), (3, 1, "O", 10.0)]
    parts, balance = world("a", orders)
    assert parts == {"classified": (1, 30), "missing": (1, 10), "exact": (1, 20), "untracked": (1, 2)} and balance == [(40, 40, 0)]
    parts, balance = world("b", orders[:2])
    assert balance == [(30, 30, 0)] and parts["classified"] == (1, 30)


def test_missing_cause_uses_names_and_places(spark):
    missing = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("sub_5", 5), ("f", 6)], "symbol string, address long")
    placed = inventories.placements(spark.createDataFrame([(1, "other"), (2, "b"), (None, "x")], "address long, symbol string"), "address", "symbol")
    made = spark.createDataFrame([("b", "u", False, True), ("c", "u", True, False), ("d", "u", False, False), ("d", "v", False, False)], "symbol string, unit string, unplaced boolean, stub boolean")
    made = inventories.candidates(made, missing, "symbol", "unit", F.col("unplaced"), F.col("stub"))
    assert ("d", 2, "u,v", False, False) in rows(made)
    got = dict(rows(inventories.missing_cause(missing, placed, made, "symbol", "address", F.col("symbol").startswith("sub_")), "symbol", "cause"))
    assert got == {"a": "matched-under-another-name", "b": "stubbed", "c": "compiled-but-unplaced", "d": "placed-in-unit-residual-skips", "sub_5": "unmapped-target-extent", "f": "not-compiled"}


def test_manifest(spark):
    files = inventories.digests(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string"), "path", "content")
    want = files.union(spark.createDataFrame([("c", "x")], "path string, sha256 string")).withColumn("sha256", F.when(F.col("path") == "b", "y").otherwise(F.col("sha256")))
    assert rows(inventories.manifest_faults(want, files)) == [("b", "changed"), ("c", "missing")]
    assert rows(inventories.manifest_faults(files, files)) == []


def test_values_that_differ(spark):
    cases = [(7, 9, "rax"), (0x1A8, 0x208, "rsp"), (0, 1, "rax"), (-1, 5, "rax"), (None, 0, "rax")]
    df = spark.createDataFrame([("constant", "different-constants", *c) for c in cases], "kind string, class string, a long, b long, site string")
    got = [r[0] for r in df.select(findings.differs_in_value(F.col("kind"), F.col("class"), F.col("a"), F.col("b"), F.array("site"))).collect()]
    assert got == [True, False, False, True, True]


def test_inlining_rows_are_shared_out(spark):
    found = spark.createDataFrame([("a", "inlining", False, 10), ("b", "inlining", False, 3), ("c", "inlining", False, 4), ("c", "padding", True, 2)], "key string, cause string, flip boolean, rows long")
    patterns = spark.createDataFrame([("a", 4, 9), ("b", 0, 1)], "key string, n_calls long, n_distribution long")
    assert rows(findings.kind_rows(found, "key", patterns)) == [("a", "block-order", 6), ("a", "calls", 4), ("b", "inline-distribution", 3), ("c", "block-order", 4), ("c", "comparison-flip", 2)]


def test_explanation(spark):
    df = findings.explained(spark.createDataFrame([("a", 0, 0, 5), ("b", 1, 2, 9), ("c", 2, 4, 9), ("d", 2, 4, 8)], "s string, e long, d long, z long"), "e", "d")
    assert [(r.s, r.explanation, r.only) for r in findings.by_explanation(df, "e", "z", "s", "s").collect()] == [("a", 1.0, True), ("c", 0.5, False), ("d", 0.5, False), ("b", 0.5, False)]


def test_frontier_needs_an_identical_prefix_and_one_new_row(spark):
    schema = "u string, i int, v string, ok boolean"
    before = spark.createDataFrame([(u, i, v, True) for u in "abcd" for i, v in enumerate("xy")], schema)
    after = [("a", 0, "x", True), ("a", 1, "y", True), ("a", 2, "z", False), ("a", 3, "w", True)]  # one accepted row beyond
    after += [("b", 0, "x", True), ("b", 1, "other", True), ("b", 2, "z", True)]  # another prefix
    after += [("c", 0, "x", True)]  # shorter
    after += [("d", i, v, True) for i, v in enumerate("xyzw")]  # two accepted
    streams = evidence.frontier(before, spark.createDataFrame(after, schema), "u", "i", ["v"], F.col("ok"))
    assert rows(streams) == [("a", 2, 4, 1, 4), ("d", 2, 4, 2, None)]
    sites = spark.createDataFrame([("a", "s1"), ("d", "s2"), ("e", "s3")], "u string, site string")
    assert rows(evidence.frontier_join(streams, sites, "u")) == [("a", 4, "s1")]
    assert rows(evidence.frontier_join(streams, sites.union(spark.createDataFrame([("a", "s4")], sites.schema)), "u")) == []


def test_disjointness_with_doubt(spark):
    changed = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", 1)], "k string, m int")
    reached = spark.createDataFrame([("a", 2), ("b", 1), ("c", 5)], "k string, m int")
    assert rows(evidence.disjoint(changed, reached, "k", "m")) == [("a", True), ("b", False), ("c", None), ("d", None)]


def test_gates(spark):
    df = spark.createDataFrame([(True, False, True, 1.0, 1.0, False), (True, None, True, None, 5.0, True), (True, None, True, None, 5.0, False), (False, False, True, 1.0, 9.0, True), (True, True, True, 2.0, 1.0, True)], "p boolean, o boolean, n boolean, x double, y double, k boolean")
    assert [r[0] for r in df.select(evidence.keep_improvement(*map(F.col, "ponxyk"))).collect()] == [True, True, False, False, False]
    gate = spark.createDataFrame([(None, None, None), (True, 5, 9), (False, 5, 4), (False, 5, 5), (False, None, 1)], "s boolean, b int, a int")
    assert [r[0] for r in gate.select(evidence.behaviour_gate(F.col("s"), F.col("b"), F.col("a"))).collect()] == [True, True, True, False, False]
    layout = "u string, i string, same boolean, placed boolean"
    before = spark.createDataFrame([(u, "x", False, True) for u in "abc"] + [("d", "x", True, True)], layout)
    after = spark.createDataFrame([("a", "x", True, True), ("b", "x", True, True), ("b", "y", True, True), ("c", "x", False, False), ("d", "x", False, True)], layout)
    got = rows(evidence.layout_gate(before, after, "u", "i"), "u", "improves", "reason")
    assert got == [("a", True, "improved"), ("b", False, "object set changed"), ("c", False, "placement became ambiguous"), ("d", False, "regressed")]


def test_phases(spark):
    """A function exact at every phase, one as the source stands, one with two more declarations, one never; a numbered clone goes by its address."""
    cases = [(p, s, e) for p in range(31) for s, e in (("always", True), ("0x4982f0", True), ("witness", p == 0), ("locked", p == 2), ("never", False))]
    df = spark.createDataFrame(cases, "phase int, symbol string, exact boolean")
    got = {r.symbol: (r.kind, r.n_exact) for r in votes.exact_sets(df, "symbol", "phase", F.col("exact"), F.col("phase") == 0, 31).collect()}
    assert got == {"always": ("always", 31), "0x4982f0": ("always", 31), "witness": ("witness", 1), "locked": ("locked", 1), "never": ("never", 0)}


def test_learning_stops_and_refuses_contradictions(spark):
    start = spark.createDataFrame([(1, 0)], "node long, value long")
    step = lambda new, known: new.where("node < 6").select((F.col("node") + 1).alias("node"), (F.col("value") + 2).alias("value"))
    assert rows(graphs.learn(step, start)) == [(n, 2 * (n - 1)) for n in range(1, 7)]
    with pytest.raises(Exception, match="two claims for 1"):
        graphs.learn(lambda new, known: new.withColumn("value", F.lit(9).cast("long")), start)
    with pytest.raises(Exception, match="claimed again: 1"):
        graphs.learn(lambda new, known: new, start)
    with pytest.raises(Exception, match="two claims for 2"):
        graphs.learn(lambda new, known: new.select(F.lit(2).cast("long").alias("node"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("value")), start)


def test_closure_by_several_hops_has_least_depths(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(50)]
    depth, todo = {0: 0, 100: 0}, [0, 100]
    for n in todo:
        for a, b in edges:
            if a == n and b not in depth:
                depth[b] = depth[n] + 1
                todo.append(b)
    df = spark.createDataFrame(edges, "source long, target long")
    start = spark.createDataFrame([(0,), (100,)], "node long")
    for hops in (1, 3, 7):
        assert {x.node: x.depth for x in graphs.closure(df, start, hops).collect()} == depth
    roots = spark.createDataFrame([(k,) for k in range(60)], "root long")
    want = sorted((a,) for a in range(60) if a == 7 or 7 in reach(edges, a))
    assert sorted(rows(graphs.users(df, roots, spark.createDataFrame([(7,)], "node long")))) == want


def reach(edges, start):
    seen, todo = {start}, [start]
    for n in todo:
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_numbering_in_ranges_equals_one_window(spark):
    r = random.Random(9)
    data = [(r.choice(["a", "a", "a", "b", None]), i) for i in r.sample(range(10_000), 3000)]
    df = spark.createDataFrame(data, "k string, o long").repartition(7)
    want = rows(bags.numbered(df, "k", "o"), "k", "o", "ordinal")
    assert rows(bags.numbered(df, "k", "o", large=True), "k", "o", "ordinal") == want
    assert len({x[2] for x in want if x[0] == "a"}) == sum(k == "a" for k, _ in data)


@pytest.mark.parametrize("most", [bags.NUMBERED_ROWS, 2])
def test_cancel_keeps_the_highest_of_the_surplus(spark, monkeypatch, most):
    monkeypatch.setattr(bags, "NUMBERED_ROWS", most)
    schema = "v string, o int"
    ours = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 1), (None, 1), (None, 2)], schema)
    theirs = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5), ("y", 6), (None, 3), ("z", 1)], schema)
    a, b = bags.cancel(ours, theirs, ["v"], "o")
    assert rows(a) == sorted([("x", 2), ("x", 3), ("x", 4), (None, 1), (None, 2)], key=str) and rows(b) == sorted([("y", 6), ("z", 1), (None, 3)], key=str)


def test_distinct_first_with_one_order_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (0, None)], "o int, t string")
    assert rows(bags.distinct_first(df, "t", "o"), "o", "t", "n_copies") == [(0, None, 1), (1, "a", 3), (1, "b", 1)]


def test_nearest_equals_brute_force(spark):
    r = random.Random(2)
    wants = [(i, r.randrange(4), r.randrange(-300, 1300)) for i in range(200)]
    extents = [(r.randrange(3), r.randrange(1000)) for _ in range(60)]
    got = {x.k: (x.place, x.distance) for x in lookups.nearest(spark.createDataFrame(wants, "k long, s long, a long"), "k", "s", "a", spark.createDataFrame(extents, "s long, p long"), "p", 40).collect()}
    want = {}
    for k, s, a in wants:
        near = [(abs(p - a), p) for z, p in extents if z == s]
        if near:
            want[k] = min(near)[::-1]
    assert got == want


def test_interval_sweep_and_holding_equal_brute_force(spark):
    r = random.Random(4)
    cover = lambda ranges: {k: {x for g, a, b in ranges if g == k for x in range(a, b)} for k in range(5)}
    sides = [[(r.randrange(5), a, a + r.randrange(1, 30)) for a in (r.randrange(100) for _ in range(12))] for _ in range(2)]
    merged = [intervals.merged(spark.createDataFrame(s, "k long, start long, end long"), "k", "start", "end") for s in sides]
    got = {x.k: (x.covered_before, x.covered_after, x.lost, x.gained) for x in intervals.lost_and_gained(*merged, "k").collect()}
    b, a = map(cover, sides)
    assert got == {k: (len(b[k]), len(a[k]), len(b[k] - a[k]), len(a[k] - b[k])) for k in range(5) if b[k] | a[k]}
    points = [(i, r.randrange(3), r.randrange(-5, 130)) for i in range(100)]
    ranges = [(n, r.randrange(3), lo, lo + r.randrange(0, 40)) for n, lo in enumerate(r.randrange(100) for _ in range(40))]
    held = intervals.holding(spark.createDataFrame(points, "i long, g long, x long"), "x", spark.createDataFrame(ranges, "n long, g long, lo long, hi long"), "lo", "hi", 16, ["g"])
    assert Counter(rows(held, "i", "n")) == Counter((i, n) for i, g, x in points for n, h, lo, hi in ranges if g == h and lo <= x <= hi)


def test_owners_by_a_sweep(spark):
    r = random.Random(13)
    points = [(k, r.choice([None, r.randrange(40), r.randrange(40) / 2])) for k in range(200)]
    ranges = [(f"o{n}", lo, lo + r.randrange(0, 15)) for n, lo in enumerate(r.randrange(45) for _ in range(12))]
    points = [(k, None if x is None else float(x)) for k, x in points]
    got = intervals.owners(spark.createDataFrame(points, "k long, x double"), "x", "k", spark.createDataFrame([(n, float(a), float(b)) for n, a, b in ranges], "o string, lo double, hi double"), "lo", "hi", "o")
    want = {}
    for k, x in points:
        held = [n for n, a, b in ranges if x is not None and a <= x < b]
        want[k] = (x, len(held), held[0] if len(held) == 1 else None)
    assert {x.k: (x.x, x.n_owners, x.owner) for x in got.collect()} == want
    assert {w[1] for w in want.values()} >= {0, 1, 2}


def test_a_long_interval_is_in_few_cells(spark):
    points = spark.createDataFrame([(k, 10.0 ** k) for k in range(9)], "k long, x double")
    ranges = spark.createDataFrame([(1, 0.0, 1e15), (2, 5.0, 50.0), (3, 7e3, 7e3), (4, 1e3, 1e3), (5, 9.0, 1.0)], "n long, lo double, hi double")
    held = intervals.holding(points, "x", ranges, "lo", "hi", 1.0)
    assert rows(held, "k", "n") == sorted([(k, 1) for k in range(9)] + [(1, 2), (3, 4)])


def test_rules_are_tried_in_order(spark):
    table = [("both", ["a", "b"], []), ("only a", ["a"], ["b"]), ("no c", [], ["c"])]
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["b"],), (["c", "b"],), ([],)], "h array<string>")
    assert [r[0] for r in df.select(rules.first_rule(F.col("h"), table, "none")).collect()] == ["both", "only a", "no c", "none", "no c"]


def test_text_of_dumps(spark):
    text = "x_12 replace with --> x_12 = y_3(D);\nnothing\nx_4(D) replace with --> t = a = b;\nPartition 3 (v - 7 8 )\nPartition 1 (w x - 9)"
    r = spark.range(1).select(X.replacements(F.lit(text)).alias("a"), X.partition_names(F.lit(text)).alias("b"), X.arrows(F.lit("rbx->rax, rdx->rcx; rsi->rax abc1->x")).alias("c")).first()
    assert [(x.version, x.value) for x in r.a] == [(12, "y_3(D)"), (4, "a = b")]
    assert [(x.version, x.name) for x in r.b] == [(7, "v"), (8, "v"), (9, "w x")]
    assert r.c == {"rax": "rsi", "rcx": "rdx"}
    one = spark.range(1).select(X.cause(F.lit("cannot use 'a b' with 'c'"), [("no such", "x")]), X.section_identity(F.lit(".text._Z3foo")), X.section_identity(F.lit(".rodata.cst8")), X.string_encoding(F.lit(".rodata.str4.16")), X.string_encoding(F.lit(".data")), X.table_entry(F.lit(-4), 4, ["a"]), X.next_in_ring(F.lit("z"), ["a"])).first()
    assert tuple(one) == ("cannot use X with X", "_Z3foo", ".rodata.cst8", "utf32le", None, None, None)
