"""Lookups and gates: indexes by key, forward and nearest lookups, adjacency, reasons, exemptions and pointer chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.intervals import holding


def unit_sets(rows: DataFrame, symbol: str, unit: str, exact: Column) -> DataFrame:
    """Per symbol: units that have it, and units where it is exact, as numbers and sorted text."""
    out = rows.groupBy(symbol).agg(F.sort_array(F.collect_set(unit)).alias("units"), F.sort_array(F.collect_set(F.when(exact, F.col(unit)))).alias("exact_units"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select(symbol, F.size("units").alias("n_units"), F.size("exact_units").alias("n_exact"), text("exact_units").alias("exact_units"))


def next_at_or_after(rows: DataFrame, group: str, order: list[str], wanted: Column, value: str) -> DataFrame:
    """Each row with the value of the first wanted row at or after it (forward as-of); null if none."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("later", F.first(F.when(wanted, F.col(value)), ignorenulls=True).over(w))


def nearest(wants: DataFrame, key: str, size: str, anchor: str, extents: DataFrame, place: str, width: float) -> DataFrame:
    """For each want the extent of its size nearest to its anchor (the lower place on ties); the sizes must agree.

    Places fall in cells of ``width``. A want meets the extents of its own cell, the last place of the
    nearest cell before it that has one and the first of the nearest after it; these come from a table
    with a row for each cell.
    """
    cell = lambda c: F.floor(F.col(c) / width).alias("_cell")
    spots = extents.select(size, place, cell(place)).where(F.col(place).isNotNull())
    wants = wants.withColumn("_cell", cell(anchor))
    ends = spots.groupBy(size, "_cell").agg(F.min(place).alias("_low"), F.max(place).alias("_high"))
    ends = ends.join(wants.select(size, "_cell").distinct(), [size, "_cell"], "full_outer")
    w = Window.partitionBy(size).orderBy("_cell")
    left = F.last("_high", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first("_low", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.withColumn("_before", left).withColumn("_after", right)
    around = ends.select(size, "_cell", F.explode(F.array_compact(F.array("_before", "_after"))).alias(place))
    columns = [key, anchor, place]
    found = wants.join(around, [size, "_cell"]).select(columns).union(wants.join(spots, [size, "_cell"]).select(columns))
    return found.groupBy(key).agg(F.min(F.struct(F.abs(F.col(place) - F.col(anchor)).alias("distance"), F.col(place).alias("place"))).alias("best")).select(key, "best.place", "best.distance")


def adjacent(rows: DataFrame, group: str, start: str, size: str, within: int) -> DataFrame:
    """Rows with whether the group's next one starts within so many of this one's end."""
    w = Window.partitionBy(group).orderBy(start)
    gap = F.lead(start).over(w) - F.col(start) - F.col(size)
    return rows.withColumn("gap", gap).withColumn("adjacent", F.coalesce((gap >= 0) & (gap <= within), F.lit(False)))


def in_ranges(points: DataFrame, group: str, point: str, ranges: DataFrame, low: str, high: str, name: str, width: float) -> DataFrame:
    """Points with each range of their group that holds them."""
    return holding(points, point, ranges.select(group, low, high, name), low, high, width, [group])


def reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of all rules that hold, in order, and a status: clean, doubtful (one) or bad."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    out = rows.withColumn("reasons", F.array_join(named, ",")).withColumn("n_reasons", F.size(named))
    return out.withColumn("status", F.when(F.col("n_reasons") == 0, "clean").when(F.col("n_reasons") == 1, "doubtful").otherwise("bad"))


def preserves_with_copies(before: DataFrame, after: DataFrame, key: str, copies: DataFrame) -> DataFrame:
    """Keys that were exact and no longer are, less those of which ``copies`` has an exact one elsewhere."""
    lost = before.where("exact").select(key).join(after.where("exact").select(key), key, "left_anti")
    return lost.join(copies.select(key).distinct(), key, "left_anti")


def signed_deltas(ours: DataFrame, theirs: DataFrame, unit: str, item: str, cost: Column, most: float) -> DataFrame:
    """Per unit the signed count differences of items, weighed by cost; kept if something differs and the cost stays within ``most``."""
    counts = ours.groupBy(unit, item).agg(F.count(F.lit(1)).alias("n")).unionByName(theirs.groupBy(unit, item).agg((-F.count(F.lit(1))).alias("n")))
    net = counts.groupBy(unit, item).agg(F.sum("n").alias("delta")).where("delta <> 0")
    out = net.groupBy(unit).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("delta") * cost).alias("net_cost"))
    return out.where(F.abs("net_cost") <= most)


def same_prefix(ours: DataFrame, theirs: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Per group of both sides: how many rows agree before the first that differs, and both sides' lengths."""
    w = Window.partitionBy(group).orderBy(*order)
    side = lambda df, name: df.select(group, F.row_number().over(w).alias("place"), F.col(value).alias(name))
    both = side(ours, "a").join(side(theirs, "b"), [group, "place"], "full_outer")
    differs = F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("place"))
    out = both.groupBy(group).agg(F.count("a").alias("n_ours"), F.count("b").alias("n_theirs"), F.min(differs).alias("first"))
    return out.where("n_ours > 0 and n_theirs > 0").select(group, "n_ours", "n_theirs", F.coalesce(F.col("first") - 1, F.col("n_ours")).alias("n_same"))
