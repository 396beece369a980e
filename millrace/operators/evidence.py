"""Evidence between rows: unique witnesses, disjoint sets, prefixes, attributions and the gates that use them.

Doubt is a result of its own: what can't be decided is null and never counts as proof.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import intervals
from millrace.sources.scratch import written


def unique_value(rows: DataFrame, key: list[str], value: str, name: str | None = None) -> DataFrame:
    """(key..., value): the value of keys that have one distinct value; others are left out (an ambiguous name names nothing)."""
    return rows.groupBy(*key).agg(F.min(value).alias(name or value), F.max(value).alias("_other")).where(F.col(name or value) == F.col("_other")).drop("_other")


def single_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys that occur once."""
    once = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return rows.join(once, key)


def rejected_sites(sites: DataFrame, functions: DataFrame, events: DataFrame) -> DataFrame:
    """Sites (caller, callee, ...) with what is known for sure of their functions and edges.

    ``functions`` (name, final_size, initial_size) count where a name occurs once; ``events`` (callee,
    growth) where all of a callee's edges grow by the same. The projected size needs both.
    """
    once = single_rows(functions, ["name"])
    caller = once.select(F.col("name").alias("caller"), F.col("final_size").alias("caller_size"), F.col("initial_size").alias("caller_initial"))
    callee = once.select(F.col("name").alias("callee"), F.col("initial_size").alias("callee_initial"))
    growth = unique_value(events.where("growth is not null"), ["callee"], "growth")
    rows = sites.join(caller, "caller", "left").join(callee, "callee", "left").join(growth, "callee", "left")
    return rows.withColumn("projected", F.col("caller_size") + F.col("growth")).withColumn("base", F.when(F.col("caller_initial").isNotNull() & F.col("callee_initial").isNotNull(), F.greatest("caller_initial", "callee_initial"))).drop("caller_initial", "callee_initial")


def frontier(before: DataFrame, after: DataFrame, unit: str, order: str, values: list[str], accepted: Column) -> DataFrame:
    """(unit, n_before, n_after, n_accepted, at): units whose later stream only goes on where the earlier one ended.

    Both sides have rows (unit, order, values...) in unique order. A unit is kept if every row of the
    earlier stream is there unchanged at its place; ``n_accepted`` counts accepted rows beyond it and
    ``at`` is the place of the only one, null if there are none or several.
    """
    place = F.row_number().over(Window.partitionBy(unit).orderBy(order))
    side = lambda df, name: df.select(unit, place.alias("place"), F.struct(*values).alias(name), accepted.alias(f"ok_{name}"))
    both = side(before, "old").join(side(after, "new"), [unit, "place"], "full_outer")
    broken = F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    fresh = F.col("old").isNull() & F.coalesce("ok_new", F.lit(False))
    out = both.groupBy(unit).agg(F.count("old").alias("n_before"), F.count("new").alias("n_after"), F.bool_or(broken).alias("broken"), F.count_if(fresh).alias("n_accepted"), F.min(F.when(fresh, F.col("place"))).alias("at"))
    return out.where("not broken and n_before > 0").drop("broken").withColumn("at", F.when(F.col("n_accepted") == 1, F.col("at")).cast("long"))


def frontier_join(streams: DataFrame, sites: DataFrame, unit: str) -> DataFrame:
    """Units whose ``frontier`` has one accepted row and whose ``sites`` (unit, site) have one transition: (unit, at, site)."""
    one = unique_value(single_rows(sites, [unit]), [unit], "site")
    return streams.where("n_accepted = 1").select(unit, "at").join(one, unit)


def disjoint(changed: DataFrame, reached: DataFrame, key: str, member: str) -> DataFrame:
    """(key, disjoint): does none of a key's ``reached`` members occur among its ``changed`` ones?

    Null, which proves nothing, where a changed member is unknown (null) or a key has no reached row.
    """
    doubt = changed.groupBy(key).agg(F.bool_or(F.col(member).isNull()).alias("doubt"))
    meet = changed.select(key, member).distinct().join(reached.select(key, member), [key, member], "left_semi").select(key).distinct().withColumn("meet", F.lit(True))
    rows = doubt.join(reached.select(key).distinct().withColumn("have", F.lit(True)), key, "left").join(meet, key, "left")
    known = ~F.col("doubt") & F.col("have").isNotNull()
    return rows.select(key, F.when(known, F.col("meet").isNull()).alias("disjoint"))


def dependents(units: DataFrame, unit: str, listing: str, paths: DataFrame, path: str) -> DataFrame:
    """(path, unit): units whose dependency listing, words between white space, has a path."""
    each = units.select(unit, F.explode(F.array_distinct(F.split(F.trim(listing), r"\s+"))).alias(path))
    return each.join(paths.select(path).distinct(), path).select(path, unit)


def calls_inside(sites: DataFrame, bodies: DataFrame, by_name: str, by_address: str) -> DataFrame:
    """Sites with whether a body (body, name, address) of theirs calls the same thing, by name or by address."""
    name = bodies.where(F.col(by_name).isNotNull()).select("body", by_name).distinct().withColumn("_name", F.lit(True))
    place = bodies.where(F.col(by_address).isNotNull()).select("body", by_address).distinct().withColumn("_place", F.lit(True))
    rows = sites.join(name, ["body", by_name], "left").join(place, ["body", by_address], "left")
    return rows.withColumn("inside", F.col("_name").isNotNull() | F.col("_place").isNotNull()).drop("_name", "_place")


def aligned_references(ours: DataFrame, theirs: DataFrame, place: list[str], order: str, value: str) -> DataFrame:
    """(place..., ordinal, ours, theirs): references paired by their order at aligned places that have equally many on both sides."""
    w = Window.partitionBy(*place)
    side = lambda df, name: df.select(*place, F.row_number().over(w.orderBy(order)).alias("ordinal"), F.count(F.lit(1)).over(w).alias("_n"), F.col(value).alias(name))
    return side(ours, "ours").join(side(theirs, "theirs"), [*place, "ordinal", "_n"]).drop("_n")


def grant_before(rows: DataFrame, group: str, order: list[str], differs: Column, wanted: Column, value: str) -> DataFrame:
    """(group, at, before): per group the first differing row's value and, if that row is a wanted one, the wanted row's latest before it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w))
    first = rows.where(differs).groupBy(group).agg(F.min(F.struct(*order, F.col(value).alias("_at"), F.col("_before"), wanted.alias("_wanted"))).alias("first"))
    return first.select(group, F.col("first._at").alias("at"), F.when(F.col("first._wanted"), F.col("first._before")).alias("before"))


def changed_rows(ours: DataFrame, theirs: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, n, n_changed, first): rows side by side by place, for groups of the same length on both sides; ``first`` is the first place that differs."""
    from millrace.operators.records import align_by_ordinal

    both = align_by_ordinal(ours, theirs, group, order, value)
    differs = ~F.col("ours").eqNullSafe(F.col("theirs"))
    return both.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("n_changed"), F.min(F.when(differs, F.col("place"))).cast("long").alias("first"))


def missing_guards(ours: DataFrame, theirs: DataFrame, group: str, order: list[str], first: Column, second: Column, signature: list[str], value: str) -> DataFrame:
    """(group, value): ours' pairs of neighbouring rows (a first, then a second) beyond the number of theirs with the same signature."""
    w = Window.partitionBy(group).orderBy(*order)

    def pairs(df: DataFrame) -> DataFrame:
        df = df.withColumns({f"_{c}": F.lead(c).over(w) for c in signature}).withColumn("_second", F.lead(second).over(w))
        return df.where(first & F.col("_second"))

    key = [group, *signature, *(f"_{c}" for c in signature)]
    own = pairs(ours).withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    have = pairs(theirs).groupBy(*key).agg(F.count(F.lit(1)).alias("_have"))
    return own.join(have, key, "left").where("_nth > coalesce(_have, 0)").select(group, value)


def block_context(rows: DataFrame, block: list[str], order: str, jump: Column, target: str, name: Column) -> DataFrame:
    """(block..., definitions, successors, n_other): sorted names defined, targets of jumps in order, and the number of other rows."""
    steps = F.sort_array(F.collect_list(F.when(jump, F.struct(F.col(order), F.col(target).cast("string").alias("to")))))
    out = rows.groupBy(*block).agg(F.sort_array(F.collect_set(F.when(~jump, name))).alias("defined"), steps.alias("steps"), F.count_if(~jump & name.isNull()).alias("n_other"))
    return out.select(*block, F.array_join("defined", ",").alias("definitions"), F.array_join(F.transform("steps", lambda s: s["to"]), ",").alias("successors"), "n_other")


def attributed(offsets: DataFrame, frames: DataFrame, offset: str, line: str, own: Column) -> DataFrame:
    """Distinct lines of frames (offset, depth, line, ...) behind differing offsets: of each offset the innermost frame that is our own."""
    inner = frames.where(own).groupBy(offset).agg(F.min(F.struct("depth", line)).alias("_frame")).select(offset, F.col(f"_frame.{line}").alias(line))
    return offsets.select(offset).distinct().join(inner, offset).select(line).distinct()


def compare_bags(ours: DataFrame, theirs: DataFrame, key: list[str], kind: str, value: str) -> DataFrame:
    """(key..., kind, ours_only, theirs_only): for each kind of item of a function (callee, constant, reference, indirect call) what one side has more of."""
    side = lambda df, name: df.groupBy(*key, kind, value).agg(F.count(F.lit(1)).alias(name))
    both = side(ours, "_o").join(side(theirs, "_t"), [*key, kind, value], "full_outer").na.fill(0, ["_o", "_t"])
    out = both.groupBy(*key, kind).agg(F.sum(F.greatest(F.col("_o") - F.col("_t"), F.lit(0))).alias("ours_only"), F.sum(F.greatest(F.col("_t") - F.col("_o"), F.lit(0))).alias("theirs_only"))
    return out.where("ours_only + theirs_only > 0")


def copy_verdicts(copies: DataFrame, credited: DataFrame, homes: DataFrame) -> DataFrame:
    """Copies (unit, symbol, size) that no place was found for, with a verdict.

    ``expected`` if ``credited`` (symbol, unit) names this unit, ``elsewhere`` if only others,
    ``possible-home`` if ``homes`` (unit, size) has a free place of the size, else ``surplus``.
    """
    credit = credited.groupBy("symbol").agg(F.collect_set("unit").alias("_units"))
    home = homes.select("unit", "size").distinct().withColumn("_home", F.lit(True))
    rows = copies.join(credit, "symbol", "left").join(home, ["unit", "size"], "left")
    verdict = F.when(F.array_contains("_units", F.col("unit")), "expected").when(F.col("_units").isNotNull(), "elsewhere").when(F.col("_home"), "possible-home").otherwise("surplus")
    return rows.withColumn("verdict", verdict).drop("_units", "_home")


def copy_context(points: DataFrame, point: str, key: list[str], ranges: DataFrame, low: str, high: str, copies: DataFrame, symbol: str) -> DataFrame:
    """(key..., context, n_copies): of findings at points in definitions [low, high], both ends included, what the definitions' out-of-line copies (symbol, exact) show.

    An exact copy proves the definition, so the caller's context remains; inexact copies make the
    definition a candidate; without a copy nothing is verified. Findings without a definition are left
    out. Definitions and copies are counted by one sweep over the ranges' ends and the places of the
    findings, each once, so no pairs are made.
    """
    told = copies.groupBy(symbol).agg(F.count("exact").alias("copies"), F.count_if("exact").alias("exact"))
    sums = ["owners", "copies", "exact"]
    rows = ranges.where(F.col(low) <= F.col(high)).join(told, symbol, "left").select(low, high, F.lit(1).cast("long").alias("owners"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums[1:]])
    rows = written(rows.groupBy(low, high).agg(*[F.sum(c).alias(c) for c in sums]), "definitions")
    # at one place ranges begin before it is asked for, and end after it
    events = points.select(F.col(point).alias("at")).where("at is not null").distinct().select("at", F.lit(1).alias("late"), *[F.lit(0).cast("long").alias(c) for c in sums])
    for at, late, sign in ((low, 0, 1), (high, 2, -1)):
        events = events.union(rows.select(at, F.lit(late), *[sign * F.col(c) for c in sums]))
    found = written(intervals.swept(events, ["at", "late"], sums).where("late = 1 and owners > 0").select(F.col("at").alias(point), "copies", "exact"), "found")
    out = points.select(*key, point).join(found, point).groupBy(*key).agg(F.sum("copies").alias("n_copies"), F.sum("exact").alias("_exact"))
    context = F.when(F.col("_exact") > 0, "caller-context").when(F.col("n_copies") > 0, "header-candidate").otherwise("header-unverified")
    return out.select(*key, context.alias("context"), "n_copies")


def described(findings: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, cause, first_line, n_lines): of findings (key, at, cause) the cause of the first, and the lines of records (key, at, line) at or before each."""
    w = Window.partitionBy(key).orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    side = lambda df, s, cause, line: df.select(key, "at", F.lit(s).alias("_side"), cause.alias("cause"), line.cast("long").alias("_line"))
    rows = side(records, 0, F.lit(None).cast("string"), F.col("line")).union(side(findings, 1, F.col("cause"), F.lit(None)))
    rows = rows.withColumn("line", F.last("_line", ignorenulls=True).over(w)).where("_side = 1")
    out = rows.groupBy(key).agg(F.min(F.struct("at", "cause", "line")).alias("first"), F.count_distinct("line").alias("n_lines"))
    return out.select(key, "first.cause", F.col("first.line").alias("first_line"), "n_lines")


def with_previous(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows with the one before them in their group as a struct ``previous``; null for the first."""
    return rows.withColumn("previous", F.lag(F.struct(*columns)).over(Window.partitionBy(group).orderBy(*order)))


def completed(listing: DataFrame, source: DataFrame, number: str, text: str, cut: Column) -> DataFrame:
    """Listing rows whose cut text is taken from the source row that their own line number names; without one they stay as they are."""
    whole = source.select(number, F.col(text).alias("_whole"))
    return listing.join(whole, number, "left").withColumn(text, F.when(cut, F.coalesce("_whole", text)).otherwise(F.col(text))).drop("_whole")


def references(rows: DataFrame, functions: DataFrame, section: str, place: Column) -> DataFrame:
    """Rows with (name, offset) of what they point at: a function that begins there, by its name and 0, else the section and the place."""
    rows = rows.withColumn("_place", place)
    starts = functions.select(F.col("section").alias(section), F.col("start").alias("_place"), F.col("name").alias("_name"))
    found = rows.join(starts, [section, "_place"], "left")
    return found.withColumn("name", F.coalesce(F.col("_name"), F.col(section).cast("string"))).withColumn("offset", F.when(F.col("_name").isNotNull(), 0).otherwise(F.col("_place"))).drop("_place", "_name")


def constructs(locations: DataFrame, lines: DataFrame) -> DataFrame:
    """Locations (path, line) with the trimmed text of their source line; null where the source has none."""
    return locations.join(lines.select("path", "line", F.trim("text").alias("construct")), ["path", "line"], "left")


def of_kinds(rows: DataFrame, evidence: str, kinds: list[str]) -> DataFrame:
    """Rows whose evidence is of one of the kinds: the text before its first colon."""
    return rows.where(F.split_part(F.col(evidence), F.lit(":"), F.lit(1)).isin(kinds))


def own_exact(rows: DataFrame, definitions: DataFrame, key: list[str], exact: Column, excluded: list[str]) -> DataFrame:
    """Distinct keys of exact rows that their own unit defines (``definitions`` has the key), less names that begin with an excluded prefix."""
    name = F.col(key[-1])
    barred = F.lit(False)
    for prefix in excluded:
        barred = barred | name.startswith(prefix)
    return rows.where(exact & ~barred).select(*key).distinct().join(definitions.select(*key).distinct(), key, "left_semi")


def together(parts: list[DataFrame]) -> DataFrame:
    """The results of several units as one."""
    return reduce(DataFrame.unionByName, parts)


def families(edits: DataFrame, key: list[str], name: str, order: str) -> DataFrame:
    """(key..., n, names): the registered edits of each key in their order, as text."""
    held = F.sort_array(F.collect_list(F.struct(order, name)))
    return edits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(held, lambda x: x[name]), ",").alias("names"))


def gathered(functions: DataFrame, differences: DataFrame, key: list[str], size: str, unreadable: Column) -> tuple[DataFrame, DataFrame]:
    """(key..., size, n): functions with differences, and (key..., reason) of those that were left out. A report sorts them by size."""
    counts = differences.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    skipped = functions.where(unreadable).select(*key, F.lit("unreadable").alias("reason"))
    found = functions.where(~unreadable).join(counts, key).select(*key, size, "n")
    return found, skipped


# --- gates ---------------------------------------------------------------------------------------


def layout_gate(before: DataFrame, after: DataFrame, unit: str, item: str) -> DataFrame:
    """(unit, improves, reason, n_improved): items (unit, item, same, placed) of two builds; one that goes, regresses or loses its place ends it."""
    side = lambda df, s: df.select(unit, item, F.lit(True).alias(f"_has_{s}"), F.col("same").alias(f"_same_{s}"), F.col("placed").alias(f"_placed_{s}"))
    both = side(before, "b").join(side(after, "a"), [unit, item], "full_outer")
    changed = F.col("_has_b").isNull() | F.col("_has_a").isNull()
    out = both.groupBy(unit).agg(
        F.bool_or(changed).alias("_changed"), F.coalesce(F.bool_or(F.col("_same_b") & ~F.col("_same_a")), F.lit(False)).alias("_regressed"), F.coalesce(F.bool_or(F.col("_placed_b") & ~F.col("_placed_a")), F.lit(False)).alias("_lost"), F.count_if(~F.col("_same_b") & F.col("_same_a")).alias("n_improved")
    )
    reason = F.when(F.col("_changed"), "object set changed").when(F.col("_regressed"), "regressed").when(F.col("_lost"), "placement became ambiguous").when(F.col("n_improved") > 0, "improved").otherwise("no improvement")
    return out.select(unit, (reason == "improved").alias("improves"), reason.alias("reason"), "n_improved")


def keep_improvement(preserves: Column, old_exact: Column, new_exact: Column, old_score: Column, new_score: Column, known: Column) -> Column:
    """Keep a candidate that costs its unit nothing if its row improves, or is new, known and exact. A null ``old_exact`` means no row before."""
    better = (new_score > old_score) | (new_exact & ~old_exact)
    return F.coalesce(preserves & F.when(old_exact.isNull(), known & new_exact).otherwise(better), F.lit(False))


def behaviour_gate(same: Column, before: Column, after: Column) -> Column:
    """Keep what behaves the same, or differs from the original in fewer cases than before; unknown behaviour (no oracle) is kept."""
    return F.when(same.isNull() | same, True).otherwise(F.coalesce(after < before, F.lit(False)))


def exact_unless_failed(rows: DataFrame, unit: str, symbol: str, exact: Column, failed: Column) -> DataFrame:
    """(unit, symbols, n): sorted exact symbols per unit as text; null if a row of the unit failed."""
    out = rows.groupBy(unit).agg(F.bool_or(failed).alias("_failed"), F.sort_array(F.collect_set(F.when(exact, F.col(symbol)))).alias("_set"))
    ok = lambda c: F.when(~F.col("_failed"), c)
    return out.select(unit, ok(F.array_join(F.transform("_set", lambda x: x.cast("string")), ",")).alias("symbols"), ok(F.size("_set")).alias("n"))


def same_code(before: DataFrame, after: DataFrame, unit: str, section: str, content: str, relocation: list[str]) -> DataFrame:
    """(unit, same): are the sections' bytes and the bags of their relocations equal? Rows are relocations with their section's content."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    side = lambda df, n: df.groupBy(unit, section, digest.alias("_digest"), *relocation).agg(F.count(F.lit(1)).alias(n))
    both = side(before, "_b").join(side(after, "_a"), [unit, section, "_digest", *relocation], "full_outer")
    return both.groupBy(unit).agg(F.bool_and(F.col("_b").eqNullSafe(F.col("_a"))).alias("same"))


def unique_edits(sources: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, result): sources with each edit (key, name, old, new) whose old text they hold exactly once."""
    rows = sources.join(edits, key)
    whole, gone = F.length(text), F.length(F.replace(F.col(text), F.col("old"), F.lit("")))
    once = (F.length("old") > 0) & (whole - gone == F.length("old"))
    return rows.where(once).select(key, "name", F.replace(F.col(text), F.col("old"), F.col("new")).alias("result"))
