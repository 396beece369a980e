"""Intervals: point lookups and overlap, without expanding intervals to points.

Range joins are equi-joins: an interval is on the level of its length, levels being twice as wide each,
and touches at most two cells of its level; a point is looked for in one cell of each level that occurs.
Where only numbers of intervals are asked for, one sweep over all ends gives them, without any pairs;
where only the best of them is, the nodes of a binary tree over the places do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import written


def swept(events: DataFrame, place: list[str], sums: list[str]) -> DataFrame:
    """Events with the sums of ``sums`` over all events up to them by ``place``, over the whole table.

    Events are dealt into ranges of places, summed within each, and moved on by the sums of earlier
    ranges, a row a range. Events of one place all count for each other.
    """
    dealt = written(events.repartitionByRange(*place).withColumn("_range", F.spark_partition_id()), "sweep")
    sizes = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select("_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    upto = Window.partitionBy("_range").orderBy(*place).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.select("*", *[F.sum(c).over(upto).alias(f"_in_{c}") for c in sums]).join(F.broadcast(sizes), "_range")
    return inside.select(*[c for c in events.columns if c not in sums], *[(F.col(f"_in_{c}") + F.col(f"_{c}")).alias(c) for c in sums])


def owners(points: DataFrame, point: str, key: str, intervals: DataFrame, low: str, high: str, owner: str) -> DataFrame:
    """Each point with the number of intervals [low, high) that hold it, and the owner where it is one.

    A running count of beginnings less ends tells how many intervals hold a place, and if that is one, the
    running sum of their numbers is its number.
    """
    numbered = written(intervals.select(owner, low, high, F.monotonically_increasing_id().alias("_id")).where(F.col(low) < F.col(high)), "numbered")
    number = lambda sign: (sign * F.col("_id")).cast("decimal(38,0)").alias("number")
    none = F.lit(None)
    types = {f.name: f.dataType for f in points.schema.fields}
    ends = [numbered.select(F.col(at).alias("at"), F.lit(0).alias("late"), F.lit(sign).cast("long").alias("n"), number(sign), none.cast(types[key]).alias(key)) for at, sign in ((low, 1), (high, -1))]
    asked = points.where(F.col(point).isNotNull()).select(F.col(point).alias("at"), F.lit(1).alias("late"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("number"), key)
    found = swept(ends[0].union(ends[1]).union(asked), ["at", "late"], ["n", "number"]).where("late = 1")
    found = found.select(key, F.col("n").alias("n_owners"), F.when(F.col("n") == 1, F.col("number")).cast("long").alias("_id"))
    named = found.where("_id is not null").join(numbered.select("_id", F.col(owner).alias("owner")), "_id").select(key, "owner")
    out = points.join(found.select(key, "n_owners"), key, "left").join(named, key, "left")
    return out.na.fill(0, ["n_owners"])


def merged(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Disjoint ranges [start, end) per key that cover the same points."""
    rows = ranges.select(key, F.col(start).alias("start"), F.col(end).alias("end")).where("start < end")
    w = Window.partitionBy(key).orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max("end").over(before))
    rows = rows.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(w))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def lost_and_gained(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per key: points covered before and after, lost and gained, from disjoint ranges of both sides, in one sweep over their ends."""
    ends = None
    for df, name, other in ((before, "b", "a"), (after, "a", "b")):
        for at, step in (("start", 1), ("end", -1)):
            side = df.select(key, F.col(at).alias("at"), F.lit(step).alias(name), F.lit(0).alias(other))
            ends = side if ends is None else ends.unionByName(side)
    ends = ends.groupBy(key, "at").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    w = Window.partitionBy(key).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = ends.select(key, (F.sum("b").over(upto) > 0).alias("b"), (F.sum("a").over(upto) > 0).alias("a"), (F.lead("at").over(w) - F.col("at")).alias("size"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    b, a = F.col("b"), F.col("a")
    return spans.groupBy(key).agg(total(b).alias("covered_before"), total(a).alias("covered_after"), total(b & ~a).alias("lost"), total(a & ~b).alias("gained"))


def holding(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: float, group: list[str] | None = None) -> DataFrame:
    """Points with each range [low, high], both ends included, that holds them, within ``group`` columns of both sides if given.

    Cells are ``width`` wide on the first level; choose it near the ranges' common length.
    """
    group = group or []
    size = F.greatest((F.col(high) - F.col(low)) / F.lit(float(width)), F.lit(1.0))
    ranges = ranges.where(F.col(low) <= F.col(high)).withColumn("_level", F.ceil(F.log2(size)).cast("int"))
    levels = sorted(r[0] for r in ranges.select("_level").distinct().collect())  # as many as a length has binary digits
    cell = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))))
    cells = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", cell(point))
    held = asked.join(cells, [*group, "_level", "_cell"])
    return held.where((F.col(low) <= F.col(point)) & (F.col(point) <= F.col(high))).drop("_cell", "_level")


def _nodes(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """Ranges of whole numbers [first, last) with the (level, node) that make them up: node k of level n is [k * 2**n, (k + 1) * 2**n), and at most two of a level are needed."""
    levels = ranges.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col(last) - F.col(first))).cast("int") + 1)))
    # what the larger nodes leave of the range at either end
    levels = levels.withColumn("_from", F.expr(f"shiftright({first} + shiftleft(1L, level) - 1, level)")).withColumn("_to", F.expr(f"shiftright({last}, level)")).where("_from < _to")
    ends = F.array_compact(F.array(F.when(F.col("_from") % 2 == 1, F.col("_from")), F.when(F.col("_to") % 2 == 1, F.col("_to") - 1)))
    return levels.withColumn("node", F.explode(ends)).drop("_from", "_to")


def smallest_enclosing(points: DataFrame, point: str, group: str, key: str, ranges: DataFrame, low: str, high: str, name: str, order: Column | None = None) -> DataFrame:
    """For each point the range of its group that holds it and is first by ``order`` (by default the shortest; ties: the smallest name), and the least length of those that hold it.

    No pairs of points and ranges are made: places, each once, are numbered by one sweep, a range is a
    run of numbers and so a few nodes of a binary tree, each node keeps its best range, and a place
    looks at the nodes above it, one a level. Points of one key are one. ``order`` must not fall as the name grows, as of ranges
    with the same ends the one of the smallest name takes part.
    """
    length = F.col(high) - F.col(low)
    one = ranges.where(F.col(low) <= F.col(high)).groupBy(group, low, high).agg(F.min(name).alias(name))
    one = written(one.select(F.col(group).alias("g"), F.col(low).alias("low"), F.col(high).alias("high"), F.struct((length if order is None else order).alias("by"), F.col(name).alias("name")).alias("best"), length.alias("length"), F.monotonically_increasing_id().alias("id")), "ranges")
    places = points.select(F.col(group).alias("g"), F.col(point).alias("at")).where("g is not null and at is not null").distinct()
    none = F.lit(None).cast("long").alias("id")
    # at one place ranges begin before it is counted, and end after it
    events = places.select("g", "at", F.lit(1).alias("kind"), F.lit(1).cast("long").alias("n"), none)
    for at, kind in (("low", 0), ("high", 2)):
        events = events.union(one.where("g is not null").select("g", at, F.lit(kind), F.lit(0).cast("long"), "id"))
    upto = written(swept(events, ["g", "at", "kind"], ["n"]), "upto")
    ends = upto.where("kind <> 1").groupBy("id").agg(F.min(F.when(F.col("kind") == 0, F.col("n"))).alias("first"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("last"))
    nodes = _nodes(one.join(ends.where("first < last"), "id"), "first", "last")
    nodes = written(nodes.groupBy("level", "node").agg(F.min("best").alias("best"), F.min("length").alias("length")), "nodes")
    levels = sorted(r[0] for r in nodes.select("level").distinct().collect())  # as many as a number of places has binary digits
    numbers = upto.where("kind = 1").select("g", "at", (F.col("n") - 1).alias("number"))
    asked = numbers.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("node", F.expr("shiftright(number, level)"))
    held = asked.join(nodes, ["level", "node"]).groupBy("g", "at").agg(F.min("best").alias("best"), F.min("length").alias("length"))
    held = written(held.select(F.col("g").alias(group), F.col("at").alias(point), "best", "length"), "held")
    best = points.select(key, group, point).join(held, [group, point]).groupBy(key).agg(F.min("best").alias("best"), F.min("length").alias("length"))
    return best.select(key, F.col("best.name").alias(name), "length")
