"""Recorded traces: are their artifacts the recorded ones, and is what they tell possible?

Tables are over all units; a unit's first fault, in the order of the checks, is its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """(key..., fault): rows with the first check that fails."""
    fault = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()])
    return rows.select(*key, fault.alias("fault")).where("fault is not null")


def artifact_faults(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, path, fault): recorded artifacts (unit, path, sha256) that are ``missing`` from files (unit, path, content) or ``changed``."""
    found = files.select("unit", "path", F.sha2(F.col("content").cast("binary"), 256).alias("_found"))
    rows = artifacts.join(found, ["unit", "path"], "left")
    return _first(rows, ["unit", "path"], {"missing": F.col("_found").isNull(), "changed": F.col("_found") != F.col("sha256")})


def history_faults(events: DataFrame, count: Column) -> DataFrame:
    """(unit, number, fault): a unit's first event that can't be.

    Events (unit, number, before, after, order, register, success, function, uid) search a ring of
    ``count`` registers, each from where the one before it stopped (the first from 0). A search that finds
    a register stops behind it; one that doesn't stops at 0 and has none.
    """
    w = Window.partitionBy("unit").orderBy("number")
    rows = events.withColumn("_place", F.row_number().over(w) - 1).withColumn("_at", F.coalesce(F.lag("after").over(w), F.lit(0)))
    size = F.col("_count")
    rows = rows.withColumn("_count", count.cast("int"))
    behind = F.get("order", F.pmod(F.col("after") - 1, size))
    checks = {
        "discontinuous": (F.col("number") != F.col("_place")) | (F.col("before") != F.col("_at")),
        "invalid order": F.array_sort("order") != F.sequence(F.lit(0), size - 1),
        "invalid event": (F.col("after") < 0) | (F.col("after") >= size) | (F.coalesce("function", F.lit("")) == "") | (F.coalesce("uid", F.lit(0)) <= 0),
        "does not advance": F.col("success") & ~F.col("register").eqNullSafe(behind),
        "does not reset": ~F.col("success") & ((F.col("after") != 0) | F.col("register").isNotNull()),
    }
    found = _first(rows, ["unit", "number"], checks)
    return found.groupBy("unit").agg(F.min(F.struct("number", "fault")).alias("f")).select("unit", "f.number", "f.fault")


def trace_faults(collections: DataFrame, artifacts: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """(unit, fault): the first of artifacts that aren't the recorded ones, an unverified object, an incomplete trace, an impossible event.

    ``collections`` is (unit, verified, exit_code, n_errors, n_registers).
    """
    broken = artifact_faults(artifacts, files).groupBy("unit").agg(F.min(F.struct("path", "fault")).alias("a"))
    broken = broken.select("unit", F.concat_ws(" ", F.lit("artifact"), "a.fault").alias("artifact"))
    told = events.join(collections.select("unit", "n_registers"), "unit")
    history = history_faults(told, F.col("n_registers")).select("unit", F.col("fault").alias("history"))
    rows = collections.join(broken, "unit", "left").join(history, "unit", "left")
    unverified = F.when(~F.coalesce("verified", F.lit(False)), "object not verified")
    incomplete = F.when((F.col("n_errors") > 0) | (F.col("exit_code") != 0), "incomplete trace")
    return rows.select("unit", F.coalesce("artifact", unverified, incomplete, "history").alias("fault")).where("fault is not null")


def dump_faults(collections: DataFrame, functions: DataFrame, canonical: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, fault): why a dump says nothing of the build.

    ``collections`` (unit, dump, warnings) names a dump and, or null, a file of warnings among the unit's
    artifacts. In order: a traced function (unit, symbol, code, relocations) that the canonical
    build doesn't have, or has with other bytes or relocations; a dump, then warnings, that aren't the recorded artifact.
    """
    same = canonical.select("unit", "symbol", F.col("code").alias("_code"), F.col("relocations").alias("_relocations"))
    both = functions.join(same, ["unit", "symbol"], "left")
    differs = ~(F.col("code").eqNullSafe(F.col("_code")) & F.col("relocations").eqNullSafe(F.col("_relocations")))
    other = both.groupBy("unit").agg(F.bool_or(differs).alias("other"))
    good = artifacts.join(files.select("unit", "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")), ["unit", "path", "sha256"], "left_semi").select("unit", "path").distinct()
    rows = collections.join(other, "unit", "left")
    for name in ("dump", "warnings"):
        rows = rows.join(good.select("unit", F.col("path").alias(name), F.lit(True).alias(f"{name}_good")), ["unit", name], "left")
    checks = {"function differs": F.col("other"), "dump changed": F.col("dump_good").isNull(), "warnings changed": F.col("warnings").isNotNull() & F.col("warnings_good").isNull()}
    return _first(rows, ["unit"], checks)


def require(faults: DataFrame) -> DataFrame:
    """Reading this fails if there is a fault; else it has no rows."""
    said = F.concat_ws(": ", F.col("unit").cast("string"), "fault")
    return faults.select("unit", F.raise_error(said).cast("string").alias("fault"))
