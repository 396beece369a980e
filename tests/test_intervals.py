"""Intervals: the best of those that hold a place, without their pairs."""

import random

from pyspark.sql import functions as F

from millrace.operators import evidence, intervals


def test_smallest_enclosing_equals_brute_force(spark):
    r = random.Random(9)
    points = [(k % 250, r.choice([None, 0, 1, 2]), r.choice([None, *range(-4, 70)])) for k in range(300)]
    ranges = [(n, r.choice([None, 0, 1, 2]), lo, r.choice([None, lo - 1, lo, lo + r.randrange(60)])) for n, lo in enumerate(r.choices(range(-9, 60), k=80))]
    asked = spark.createDataFrame(points, "k long, g long, x long"), spark.createDataFrame([(n, g, float(lo), None if hi is None else float(hi)) for n, g, lo, hi in ranges], "n long, g long, lo double, hi double")
    for order, weigh in ((None, lambda n, size: (size, n)), ((F.col("hi") - F.col("lo")) * 10 + F.col("n"), lambda n, size: (size * 10 + n, n))):
        of = {}
        for k, g, x in points:
            held = [(hi - lo, n) for n, h, lo, hi in ranges if None not in (g, x, hi) and g == h and lo <= x <= hi]
            if held:
                of.setdefault(k, []).extend(held)
        want = {k: (min((weigh(n, size), n) for size, n in held)[1], min(held)[0]) for k, held in of.items()}
        got = {row.k: (row.n, row.length) for row in intervals.smallest_enclosing(asked[0], "x", "g", "k", asked[1], "lo", "hi", "n", order).collect()}
        assert got == want and len(want) > 50


def test_points_that_all_ranges_hold_make_no_pairs(spark):
    n, m = 60_000, 40_000  # 2.4 billion pairs
    points = spark.range(n).select("id", F.lit(0).alias("g"), (F.col("id") % 1000).alias("x"))
    ranges = spark.range(m).select(F.col("id").alias("name"), F.lit(0).alias("g"), (-F.col("id")).alias("lo"), (F.col("id") + 1000).alias("hi"))
    got = intervals.smallest_enclosing(points, "x", "g", "id", ranges, "lo", "hi", "name")
    assert got.groupBy("name", "length").count().collect() == [(0, 1000, n)]


def test_copy_context_equals_brute_force(spark):
    r = random.Random(1)
    points = [(k % 90, r.choice([None, *range(40)])) for k in range(100)]
    ranges = [(r.choice([None, *range(12)]), lo, lo + r.randrange(-1, 9)) for lo in r.choices(range(36), k=14)]
    copies = [(r.choice([None, *range(12)]), r.choice([None, True, False, False])) for _ in range(9)]
    of = {}
    for k, x in points:
        for symbol, lo, hi in ranges:
            if x is not None and lo <= x <= hi:
                of.setdefault(k, []).extend([None, *(exact for s, exact in copies if s is not None and s == symbol)])
    told = {k: [e for e in exact if e is not None] for k, exact in of.items()}
    want = {k: ("caller-context" if any(e) else "header-candidate" if e else "header-unverified", len(e)) for k, e in told.items()}
    frames = spark.createDataFrame(points, "k long, x long"), spark.createDataFrame(ranges, "symbol long, lo int, hi int"), spark.createDataFrame(copies, "symbol long, exact boolean")
    got = evidence.copy_context(frames[0], "x", ["k"], frames[1], "lo", "hi", frames[2], "symbol")
    assert {x.k: (x.context, x.n_copies) for x in got.collect()} == want
    assert len({c for c, _ in want.values()}) == 3 and len(want) < 90


def test_copy_context_makes_no_pairs(spark):
    n, m = 60_000, 40_000  # 2.4 billion pairs
    points = spark.range(n).select("id", (F.col("id") % 1000).alias("x"))
    ranges = spark.range(m).select(F.col("id").alias("symbol"), (-F.col("id")).alias("lo"), (F.col("id") + 1000).alias("hi"))
    got = evidence.copy_context(points, "x", ["id"], ranges, "lo", "hi", ranges.select("symbol", (F.col("symbol") < 0).alias("exact")), "symbol")
    assert [tuple(x) for x in got.groupBy("context", "n_copies").count().collect()] == [("header-candidate", m, n)]
