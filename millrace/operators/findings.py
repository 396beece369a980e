"""Findings of a comparison: their kinds, counts per pattern, signals and how much they explain.

A finding has a cause; a difference has a kind (call, constant, reference, indirect) and a class.
What a cause or a name stands for is a table. Everything groups by keys that callers name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import jumps, text

#: The kind that each cause is reported as.
KIND_OF_CAUSE = {
    "register-allocation": "register-choice",
    "instruction-order": "instruction-order",
    "block-order": "block-order",
    "instruction-selection": "instruction-selection",
    "inlining": "calls",
    "immediate-or-reloc": "data",
    "reference": "data",
    "struct-layout": "data",
    "padding": "padding",
}
#: Callees that only unwinding and destruction reach, and how destructors' names end.
CLEANUP = ["_Unwind_Resume", "_ZdlPv", "_ZdaPv"]
DESTRUCTOR = "D[012]Ev$"
#: A difference in these constants alone says nothing.
SMALL = [-1, 0, 1]


def named(table: dict[str, str], key: Column, otherwise: str) -> Column:
    """The value that a table has for a key."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(otherwise))


def comparison_flip(cause: Column, ours: Column, theirs: Column) -> Column:
    """Is a finding of order a comparison the other way round?

    Of two rendered instructions (``name a, b``) both compare the same two values in the other order, or
    one jumps on the mirrored condition, wherever to. Only operand order and block order can be flips.
    """
    part = lambda c, k: F.split_part(c, F.lit(" "), F.lit(k))
    args = lambda c: F.transform(F.split(F.regexp_replace(c, r"^\S+ ?", ""), ","), lambda x: F.trim(x))
    compares = (part(ours, 1) == "cmp") & (part(theirs, 1) == "cmp")
    swapped = (F.size(args(ours)) == 2) & (args(ours) == F.reverse(args(theirs)))
    return cause.isin("operand-order", "block-order") & F.when(compares, swapped).otherwise(jumps.related(jumps.MIRRORED, part(ours, 1), part(theirs, 1)))


def registers_by_offset(findings: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key..., offset, ours, theirs): which register of theirs stands for each of ours, at each place of ours.

    Findings are (key..., cause, detail, offsets, candidate, order); those of register allocation say
    ``theirs->ours`` in their detail, for all of their offsets, or their candidate place if there are
    none. Of several findings, or pairs of one, the last counts.
    """
    rows = findings.where("cause = 'register-allocation'").select(*key, F.col(order).alias("_order"), F.when(F.size("offsets") > 0, F.col("offsets")).otherwise(F.array("candidate")).alias("offsets"), F.map_entries(text.arrows(F.col("detail"))).alias("pairs"))
    each = rows.select(*key, "_order", F.explode("pairs").alias("p"), "offsets").select(*key, "_order", F.col("p.key").alias("ours"), F.col("p.value").alias("theirs"), F.explode("offsets").alias("offset"))
    return each.groupBy(*key, "offset", "ours").agg(F.max_by("theirs", "_order").alias("theirs"))


def finding_kind(cause: Column, flip: Column) -> Column:
    """``comparison-flip`` where that is what it is, else the kind of its cause."""
    return F.when(flip, "comparison-flip").otherwise(named(KIND_OF_CAUSE, cause, "other"))


def is_cleanup(symbol: Column) -> Column:
    return F.coalesce(symbol.isin(CLEANUP) | symbol.rlike(DESTRUCTOR), F.lit(False))


def cleanup_only(callees: Column) -> Column:
    """Are there callees, and are all of them only reached by cleanup?"""
    return (F.size(callees) > 0) & F.forall(callees, is_cleanup)


def differs_in_value(kind: Column, cls: Column, ours: Column, theirs: Column, sites: Column) -> Column:
    """A constant that differs at one site, neither the stack pointer's nor between small values."""
    tells = ~(ours.isin(SMALL) & theirs.isin(SMALL))
    return (kind == "constant") & (cls == "different-constants") & ~F.array_contains(sites, "rsp") & F.coalesce(tells, F.lit(True))


def pattern_counts(differences: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n_calls, n_data, n_distribution, points_to_source) of differences (kind, class, ours, theirs, callees, count_differs).

    A call difference of cleanup alone, or one that leaves the number of calls as it is, is a matter of
    where code was inlined. Other callees count on both sides, indirect calls by their number.
    """
    other = F.col("class") == "different-callees"
    call = F.col("kind") == "call"
    cleanup = call & cleanup_only(F.col("callees"))
    counted = call & ~cleanup & (other | F.col("count_differs"))
    calls = F.when(counted, F.when(other, F.col("ours") + F.col("theirs")).otherwise(1)).when(F.col("kind") == "indirect", F.abs(F.col("ours") - F.col("theirs"))).otherwise(0)
    data = ~F.col("kind").isin("call", "indirect")
    return differences.groupBy(*key).agg(
        F.sum(calls).alias("n_calls"), F.count_if(data).alias("n_data"), F.count_if(call & ~counted).alias("n_distribution"), F.bool_or(counted | ~call).alias("points_to_source")
    )


def signals(detectors: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, signals, n): the names of the detectors that found a key, sorted, as text."""
    found = reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("signal")) for name, df in detectors.items()])
    names = F.sort_array(F.collect_set("signal"))
    return found.groupBy(key).agg(names.alias("names")).select(key, F.array_join("names", ",").alias("signals"), F.size("names").alias("n"))


def kind_evidence(findings: DataFrame, key: str, patterns: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(key, kind, detail, n): rows per kind of findings (key, cause, flip, rows, offsets, detail), with what they are evidenced by.

    A finding's n-th row is at its n-th offset; rows at one of the ``checks`` (key, offset) are enum
    checks. The rows of inlining are shared out by ``patterns``: as many as these count are calls, the
    rest is block order; without counted calls they are all inline distribution if that was seen, else
    block order. Rows that a count alone gives have no detail.
    """
    plain = findings.where("cause <> 'inlining'")
    kind = finding_kind(F.col("cause"), F.col("flip"))
    if checks is None:
        rows = plain.select(key, kind.alias("kind"), "detail", F.col("rows").alias("n"))
    else:
        placed = F.slice("offsets", 1, F.least(F.col("rows"), F.size("offsets")).cast("int"))
        at = plain.select(key, kind.alias("kind"), "detail", F.explode(placed).alias("offset")).join(checks.select(key, "offset").distinct(), [key, "offset"])
        checked = at.groupBy(key, "kind", "detail").agg(F.count(F.lit(1)).alias("n"))
        # what is checked leaves its kind
        rows = plain.select(key, kind.alias("kind"), "detail", F.col("rows").alias("n")).unionByName(checked.select(key, "kind", "detail", (-F.col("n")).alias("n")))
        rows = rows.unionByName(checked.select(key, F.lit("enum-check").alias("kind"), "detail", "n"))
    inlining = findings.where("cause = 'inlining'")
    of_patterns = lambda df: df.join(patterns, key, "left").na.fill(0, ["n_calls", "n_distribution"])
    total = of_patterns(inlining.groupBy(key).agg(F.sum("rows").alias("rows"))).where("n_calls > 0")
    calls = F.least("rows", "n_calls")
    share = lambda name, n: F.struct(F.lit(name).alias("kind"), F.lit(None).cast("string").alias("detail"), n.cast("long").alias("n"))
    counted = total.select(key, F.inline(F.array(share("calls", calls), share("block-order", F.col("rows") - calls))))
    uncounted = of_patterns(inlining).where("n_calls = 0").select(key, F.when(F.col("n_distribution") > 0, "inline-distribution").otherwise("block-order").alias("kind"), "detail", F.col("rows").alias("n"))
    return rows.unionByName(counted).unionByName(uncounted).groupBy(key, "kind", "detail").agg(F.sum("n").cast("long").alias("n")).where("n > 0")


def kind_rows(findings: DataFrame, key: str, patterns: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(key, kind, n): ``kind_evidence`` without the evidence."""
    if "detail" not in findings.columns:
        findings = findings.withColumn("detail", F.lit(None).cast("string"))
    return kind_evidence(findings, key, patterns, checks).groupBy(key, "kind").agg(F.sum("n").alias("n"))


def explained(rows: DataFrame, explained: str, differing: str) -> DataFrame:
    """Rows with the share of their differences that is explained (1 without any), and whether that is all."""
    share = F.when(F.col(differing) == 0, F.lit(1.0)).otherwise(F.col(explained) / F.col(differing))
    return rows.withColumn("explanation", share).withColumn("only", F.col(explained) == F.col(differing))


def by_explanation(rows: DataFrame, explained: str, size: str, unit: str, symbol: str) -> DataFrame:
    """In the report's order: most explained, most explained places, largest, then by name."""
    return rows.orderBy(F.desc("explanation"), F.desc(explained), F.desc(size), unit, symbol)


def cause_totals(rows: DataFrame, cause: str, size: str) -> DataFrame:
    """(cause, n, bytes)."""
    return rows.groupBy(cause).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def cause_class(causes: Column) -> Column:
    """Of a function's set of causes: stack layout (with or without registers), registers alone, or others."""
    has = lambda c: F.array_contains(causes, c)
    rest = F.size(F.array_except(causes, F.array(F.lit("stack-layout"), F.lit("register-allocation"))))
    return F.when((rest > 0) | (F.size(causes) == 0), "other-differences").when(has("stack-layout"), "frame-and-register").otherwise("register-only")


def frame_census(candidates: DataFrame, causes: DataFrame) -> DataFrame:
    """(address, symbol, category, size, calls, score, n_units, first_unit): inexact functions of the target's size and number of calls, by what differs.

    ``candidates`` are (unit, symbol, address, known_address, size, target_size, calls, target_calls, score, exact):
    only those at their own address, of known and equal size and equally many calls count. ``causes`` is (address, cause).
    """
    fits = (F.col("size") == F.col("target_size")) & (F.col("calls") == F.col("target_calls")) & (F.col("known_address") == F.col("address"))
    one = candidates.where(~F.col("exact") & (F.col("score") < 100) & fits).groupBy("address").agg(
        F.min_by("symbol", "unit").alias("symbol"), F.min("size").alias("size"), F.min("calls").alias("calls"), F.min("score").alias("score"), F.count_distinct("unit").alias("n_units"), F.min("unit").alias("first_unit")
    )
    sets = causes.groupBy("address").agg(F.collect_set("cause").alias("causes"))  # at most one entry a cause
    rows = one.join(sets, "address", "left")
    return rows.select("address", "symbol", cause_class(F.coalesce("causes", F.array().cast("array<string>"))).alias("category"), "size", "calls", "score", "n_units", "first_unit")


def register_groups(census: DataFrame) -> DataFrame:
    """(unit, n, bytes): functions of ``frame_census`` whose registers alone differ, by their first unit."""
    return census.where("category = 'register-only'").groupBy(F.col("first_unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def flip_summary(flips: DataFrame, functions: DataFrame) -> DataFrame:
    """(functions, bytes, single_flip_functions, flips, unit_occurrences) over functions (symbol, unit, size) with flips (symbol, at): a function's size counts once, its units each."""
    n = flips.select("symbol", "at").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    one = functions.groupBy("symbol").agg(F.min("size").alias("size"), F.count_distinct("unit").alias("units")).join(n, "symbol")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return one.agg(F.count(F.lit(1)).alias("functions"), zero("size").alias("bytes"), F.count_if(F.col("n") == 1).alias("single_flip_functions"), zero("n").alias("flips"), zero("units").alias("unit_occurrences"))


def callee_rank(functions: DataFrame, callees: Column) -> DataFrame:
    """(callee, n, bytes, first): functions (symbol, size) behind each callee of an array, with the first of their names."""
    each = functions.select("symbol", "size", F.explode(F.array_distinct(callees)).alias("callee"))
    return each.groupBy("callee").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("symbol").alias("first"))
