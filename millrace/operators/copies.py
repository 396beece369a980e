"""Copies of definitions that units emit, compared with what the target holds: all units at once.

Inputs are tables over all units:

* ``ours`` (unit, symbol, size, state): functions that we emit; a copy's ``state`` is ``placed``, ``unplaced`` or null;
* ``rows`` (unit, symbol, address, size): functions that a report places;
* ``extents`` (address, size, kind): the target's functions, and ``named`` (address, symbol) what is known of them;
* ``spans`` (unit, low, high): where a unit's code lies in the target, the end excluded;
* ``credit`` (unit, symbol, marker): what another build's map says that a unit emits;
* calls (unit, function, callee, n) of either side, direct ones by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import intervals

#: Fixed value: the name of a function of the target that has none, with its address.
UNNAMED = r"^sub_([0-9a-fA-F]+)$"
#: Fixed value: the function that sets up a unit's static objects; each unit has its own.
SETUP = "_GLOBAL__I"
#: What a verdict on a copy without a place means, in reports.
VERDICTS = {
    "expected": "unplaced; the map credits this unit",
    "elsewhere": "unplaced; the map credits only other units",
    "possible-home": "unplaced; an unnamed extent of its size is in the span",
    "surplus": "emitted; no trace of a copy out of line anywhere",
}


def addressed(calls: DataFrame, named: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Calls with the callee's ``address``: the one in an unnamed function's name, else the name's, else where the unit's own report places it; null for none."""
    names = named.groupBy(F.col("symbol").alias("callee")).agg(F.max("address").alias("_named"))
    rows = calls.join(names, "callee", "left")
    spelled = F.conv(F.regexp_extract("callee", UNNAMED, 1), 16, 10).cast("long")
    address = F.when(F.col("callee").rlike(UNNAMED), spelled) if placed is None else F.lit(None).cast("long")
    address = F.coalesce(address, "_named")
    if placed is not None:
        own = placed.groupBy("unit", F.col("symbol").alias("callee")).agg(F.max("address").alias("_placed"))
        rows = rows.join(own, ["unit", "callee"], "left")
        address = F.coalesce(address, "_placed")
    return rows.withColumn("address", address).drop("_named", "_placed")


def homes(extents: DataFrame, spans: DataFrame, rows: DataFrame, named: DataFrame, called: DataFrame, width: float) -> DataFrame:
    """(unit, address, size, kind, symbol, called): extents where no function of the unit is placed, in its span, or unnamed ones that its target code calls.

    ``called`` is how many calls there are (unit, address, called).
    """
    known = extents.join(named.groupBy("address").agg(F.max("symbol").alias("symbol")), "address", "left")
    inside = intervals.holding(known, "address", spans.withColumn("last", F.col("high") - 1), "low", "last", width).select("unit", "address", "size", "kind", "symbol")
    reached = called.select("unit", "address").join(known.where("symbol is null"), "address").select("unit", "address", "size", "kind", "symbol")
    both = inside.union(reached).distinct().join(rows.select("unit", "address"), ["unit", "address"], "left_anti")
    return both.join(called, ["unit", "address"], "left").na.fill(0, ["called"])


def elsewhere(found: DataFrame, emitted: DataFrame, exact: DataFrame) -> DataFrame:
    """Findings (unit, symbol, ...) with in how many other units the symbol is emitted, and exact."""
    for name, held in (("emitted_elsewhere", emitted), ("exact_elsewhere", exact)):
        pairs = held.select("unit", "symbol").distinct()
        total = pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("_all"))
        own = pairs.withColumn("_own", F.lit(1))
        found = found.join(total, "symbol", "left").join(own, ["unit", "symbol"], "left")
        found = found.withColumn(name, F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).drop("_all", "_own")
    return found


def unplaced(ours: DataFrame, free: DataFrame, credit: DataFrame) -> DataFrame:
    """(unit, symbol, size, verdict, credited, n_homes): copies that no place was found for, and in how many other units the map has them."""
    pairs = credit.select("unit", "symbol").distinct()
    total = pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("_all"))
    sizes = free.groupBy("unit", "size").agg(F.count(F.lit(1)).alias("n_homes"))
    rows = ours.where("state = 'unplaced'").select("unit", "symbol", "size").join(total, "symbol", "left").join(pairs.withColumn("_own", F.lit(1)), ["unit", "symbol"], "left").join(sizes, ["unit", "size"], "left")
    verdict = F.when(F.col("_own").isNotNull(), "expected").when(F.col("_all").isNotNull(), "elsewhere").when(F.col("n_homes").isNotNull(), "possible-home").otherwise("surplus")
    credited = F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))
    return rows.select("unit", "symbol", "size", verdict.alias("verdict"), credited.alias("credited"), F.coalesce("n_homes", F.lit(0)).alias("n_homes"))


def target_only(free: DataFrame, homeless: DataFrame) -> DataFrame:
    """The free extents of a unit that have no unplaced copy of their size."""
    return free.join(homeless.select("unit", "size").distinct(), ["unit", "size"], "left_anti")


def differing(rows: DataFrame, extents: DataFrame) -> DataFrame:
    """(unit, symbol, ours, target): placed functions whose extent in the target is of another size."""
    both = rows.join(extents.select("address", F.col("size").alias("target")), "address")
    return both.where("size <> target").select("unit", "symbol", F.col("size").alias("ours"), "target")


def credited_only(credit: DataFrame, ours: DataFrame) -> DataFrame:
    """(unit, symbol, marker, missing): rows of the map that the unit emits nothing for; ``missing`` if some unit does, else it is the other build's own.

    The set-up function goes by its kind, not its name, as each unit's has its own.
    """
    setup = lambda c: F.when(F.col(c).startswith(SETUP), F.lit(SETUP)).otherwise(F.col(c))
    have = ours.select("unit", setup("symbol").alias("_kind")).distinct()
    rows = credit.select("unit", "symbol", "marker", setup("symbol").alias("_kind")).join(have, ["unit", "_kind"], "left_anti")
    emitted = ours.select("symbol").distinct().withColumn("missing", F.lit(True))
    return rows.join(emitted, "symbol", "left").na.fill(False, ["missing"]).select("unit", "symbol", "marker", "missing")


def call_differences(ours: DataFrame, theirs: DataFrame, named: DataFrame, placed: DataFrame) -> DataFrame:
    """(unit, function, side, callee, n): direct calls that one side makes more often, for functions of both sides.

    Equal names cancel first; what is left cancels where both sides' callees have one address, the first
    names of either side first. A callee of the target with an address goes by its known name.
    """
    key = ["unit", "function"]
    both = ours.groupBy(*key, "callee").agg(F.sum("n").alias("o")).join(theirs.groupBy(*key, "callee").agg(F.sum("n").alias("t")), [*key, "callee"], "full_outer").na.fill(0, ["o", "t"])
    over = lambda a, b, name: both.where(f"{a} > {b}").select(*key, "callee", (F.col(a) - F.col(b)).alias("n"))
    left = addressed(over("o", "t", "ours"), named, placed).withColumn("side", F.lit("ours"))
    right = addressed(over("t", "o", "theirs"), named).withColumn("side", F.lit("theirs"))
    rest = left.unionByName(right)
    at = Window.partitionBy(*key, "address")
    upto = Window.partitionBy(*key, "address", "side").orderBy("callee").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).over(at)
    rest = rest.withColumn("gone", F.when(F.col("address").isNull(), 0).otherwise(F.least(total("ours"), total("theirs")))).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    stays = F.col("n") - F.greatest(F.lit(0), F.least(F.col("n"), F.col("gone") - F.col("before")))
    names = named.groupBy("address").agg(F.max("symbol").alias("_name"))
    rest = rest.withColumn("n", stays).where("n > 0").join(names, "address", "left")
    spelled = F.coalesce("_name", F.concat(F.lit("sub_"), F.lower(F.hex("address"))))
    callee = F.when((F.col("side") == "theirs") & F.col("address").isNotNull(), spelled).otherwise(F.col("callee"))
    return rest.groupBy(*key, "side", callee.alias("callee")).agg(F.sum("n").alias("n"))


def indirect_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(unit, function, ours, theirs): functions of both sides with other numbers (unit, function, n) of indirect calls."""
    both = ours.select("unit", "function", F.col("n").alias("ours")).join(theirs.select("unit", "function", F.col("n").alias("theirs")), ["unit", "function"])
    return both.where("ours <> theirs")


def note(emitted: Column, exact: Column) -> Column:
    """What a report adds of other units."""
    return F.concat(F.when(emitted > 0, F.format_string("; emitted in %d other units", emitted)).otherwise(""), F.when(exact > 0, F.format_string(", exact in %d", exact)).otherwise(""))


def report(differs: DataFrame, homeless: DataFrame, only: DataFrame, missing: DataFrame, calls: DataFrame, indirect: DataFrame) -> DataFrame:
    """(unit, rank, name, line): the findings of every unit as lines, by kind and name; ``differs`` and ``homeless`` with ``elsewhere``."""
    said = F.element_at(F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair]), F.col("verdict"))
    there = note(F.col("emitted_elsewhere"), F.col("exact_elsewhere"))
    hexadecimal = F.lower(F.hex("address"))
    line = lambda rows, rank, name, text: rows.select("unit", F.lit(rank).alias("rank"), name.alias("name"), text.alias("line"))
    symbol = F.col("symbol")
    parts = [
        line(differs, 1, symbol, F.concat(F.format_string("different definition: %s, ours %d bytes, target %d", symbol, "ours", "target"), there)),
        line(homeless, 2, symbol, F.concat(said, F.when(F.col("credited") > 0, F.format_string(" (%d)", "credited")).otherwise(""), F.format_string(": %s, %d bytes", symbol, "size"), there)),
        line(only, 3, F.lpad(hexadecimal, 16, "0"), F.concat(F.format_string("target only at 0x%s, %d bytes: ", hexadecimal, "size"), F.coalesce(symbol, F.lit("unnamed")), F.when(F.col("called") > 0, F.format_string(", called %d times", "called")).otherwise(""))),
        line(missing.where("missing"), 4, symbol, F.format_string("credited by %s, not emitted: %s", "marker", symbol)),
        line(calls.where("side = 'ours'"), 5, F.concat_ws(" ", "function", "callee"), F.format_string("%s: we call %s %d times more", "function", "callee", "n")),
        line(calls.where("side = 'theirs'"), 6, F.concat_ws(" ", "function", "callee"), F.format_string("%s: the target calls %s %d times more", "function", "callee", "n")),
        line(indirect, 7, F.col("function"), F.format_string("%s: indirect calls, ours %d, target %d", "function", "ours", "theirs")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
