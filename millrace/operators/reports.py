"""Reports of single analyses as lines: (unit, rank..., line), to be put on pages by ``functions.render``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of an object of static data that a report names.
NAMED_STATES = ["layout-differs", "size-differs", "size-unverified", "ambiguous"]


def _hex(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c.cast("long"))))


def difference_text(d: DataFrame) -> Column:
    """What a difference (kind, class, ours, theirs, ours_n, theirs_n) says."""
    kind, cls = F.col("kind"), F.col("class")
    say = lambda text, *c: F.format_string(text, *c)
    counted = lambda c: F.format_string("%s occurs %d times in ours and %d times in the target", c, "ours_n", "theirs_n")
    either = F.coalesce("ours", "theirs")
    who = lambda a, b: F.when(F.col("ours").isNotNull(), a).otherwise(b)
    return (
        F.when((kind == "call") & (cls == "different-callees"), say("calls: ours also calls %s, the target %s", "ours", "theirs"))
        .when(kind == "call", F.concat(F.lit("calls: "), who("ours", "the target"), F.lit(" calls "), either, F.lit(" more often")))
        .when((kind == "constant") & (cls == "different-constants"), say("constants: %s may stand for %s", "ours", "theirs"))
        .when(kind == "constant", F.concat(F.lit("constants: "), counted(either)))
        .when((kind == "reference") & (cls == "different-references"), say("references: %s may stand for %s", "ours", "theirs"))
        .when((kind == "reference") & (cls == "count"), F.concat(F.lit("references: "), counted(either)))
        .when(kind == "reference", F.concat(F.lit("references: "), who("ours", "the target"), F.lit(" uses "), either, F.lit(" more often")))
        .otherwise(say("indirect calls: ours %d, the target %d", "ours_n", "theirs_n"))
    )


def differences(functions: DataFrame, found: DataFrame) -> DataFrame:
    """(unit, symbol, rank, n, line): of each function (unit, symbol, bytes, verified, stub) a head and its differences, equal ones once with their number."""
    flags = F.concat_ws(", ", F.when(~F.col("verified"), "unverified address"), F.when(F.col("stub"), "stub"))
    head = functions.select("unit", "symbol", F.lit(0).alias("rank"), F.lit("").alias("name"), F.concat(F.format_string("%7dB  %s  %s", "bytes", F.col("unit").cast("string"), "symbol"), F.when(flags != "", F.concat(F.lit("  ["), flags, F.lit("]"))).otherwise("")).alias("line"))
    each = found.join(functions.select("unit", "symbol"), ["unit", "symbol"]).select("unit", "symbol", difference_text(found).alias("said"))
    counted = each.groupBy("unit", "symbol", "said").agg(F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("n") > 1, F.format_string(" x%d", "n")).otherwise("")
    return head.union(counted.select("unit", "symbol", F.lit(1), "said", F.concat(F.lit("    "), "said", times)))


def statics(sections: DataFrame, sizes: DataFrame, objects: DataFrame) -> DataFrame:
    """(unit, rank, name, place, line) of proposals for static data.

    ``sections`` (unit, section, order_differs, definitions) appear if their order differs or a size of theirs comes
    from a run of pointers, with all of their ``sizes`` (unit, section, symbol, size, basis);
    ``objects`` (unit, symbol, section, at, size, target_section, target_at, target_size, state, n_references, n_outliers) if their state is one of NAMED_STATES.
    """
    runs = sizes.where("basis = 'target-pointer-run'").select("unit", "section").distinct().withColumn("_run", F.lit(True))
    shown = sections.join(runs, ["unit", "section"], "left").where("order_differs or _run")
    head = shown.select("unit", F.lit(1).alias("rank"), F.col("section").alias("name"), F.lit("").alias("place"), F.format_string("  %s: order differs: %s; definitions: %s", "section", F.col("order_differs").cast("string"), F.array_join("definitions", " -> ")).alias("line"))
    rows = sizes.join(shown.select("unit", "section"), ["unit", "section"]).select("unit", F.lit(1), F.col("section"), F.concat(F.lit(" "), "symbol"), F.format_string("    %s: size %d (%s)", "symbol", "size", "basis"))
    things = objects.where(F.col("state").isin(NAMED_STATES))
    text = F.concat(F.format_string("  %s: %s+", "symbol", "section"), _hex(F.col("at")), F.format_string("/%d -> %s+", "size", "target_section"), _hex(F.col("target_at")), F.format_string("/%d (%s, %d references, %d outliers)", "target_size", "state", "n_references", "n_outliers"))
    return head.union(rows).union(things.select("unit", F.lit(2), "symbol", F.lit(""), text))


def decisions(findings: DataFrame, operands: DataFrame, changes: DataFrame) -> DataFrame:
    """(unit, at, rank, place, line) of where a difference was decided.

    ``findings`` are (unit, at, cause, pass, kind, path, line_no, text, tree, reason): without a ``pass`` nothing was
    traced. Where ``tree`` is ``observed-ssa-pair`` the finding's ``operands`` (unit, at, place, name, origin,
    creation_pass, definition, path, line_no, recycled_from) and ``changes`` (unit, at, place, kind, pass, before, after)
    follow, else the reason why there is no pair.
    """
    where = lambda: F.format_string("%s:%s", F.coalesce("path", F.lit("?")), F.coalesce(F.col("line_no").cast("string"), F.lit("?")))
    head = F.when(F.col("pass").isNull(), F.concat(F.lit("  +"), _hex(F.col("at")), F.format_string(": %s: no traced instruction", "cause")))
    head = head.otherwise(F.concat(F.lit("  +"), _hex(F.col("at")), F.format_string(": %s (%s), ", "pass", "kind"), where(), F.lit(": "), F.coalesce("text", F.lit(""))))
    out = findings.select("unit", "at", F.lit(0).alias("rank"), F.lit(0).alias("place"), head.alias("line"))
    traced = findings.where("pass is not null")
    pairs = traced.where("tree = 'observed-ssa-pair'").select("unit", "at")
    unresolved = traced.where("tree is not null and tree <> 'observed-ssa-pair'").select("unit", "at", F.lit(1), F.lit(0), F.format_string("    tree unresolved: %s", F.coalesce("reason", F.lit("no unique pair"))))
    told = operands.join(pairs, ["unit", "at"])
    made = F.when(F.col("creation_pass").isNotNull(), F.format_string("    %s created in %s: %s", "name", "creation_pass", "definition"))
    made = made.when(F.col("origin") == "function-entry", F.concat(F.format_string("    %s is there at entry: ", "name"), where()))
    born = told.select("unit", "at", F.lit(2), F.col("place") * 2, made.alias("line")).where("line is not null")
    again = told.where("recycled_from is not null").select("unit", "at", F.lit(2), F.col("place") * 2 + 1, F.format_string("      version recycled from %s", "recycled_from"))
    moved = changes.join(pairs, ["unit", "at"]).select("unit", "at", F.lit(3), "place", F.when(F.col("kind") == "order", F.format_string("    order reverses in %s: %s -> %s", "pass", "before", "after")).otherwise(F.format_string("    comparison mirrored in %s: %s", "pass", "after")))
    for part in (unresolved, born, again, moved):
        out = out.union(part)
    return out
