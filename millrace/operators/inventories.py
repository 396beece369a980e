"""Inventories: two lists of the same things held against each other, indexes of who has what, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(inventory: DataFrame, findings: DataFrame, key: str, size: str = "size", exact: str = "exact") -> DataFrame:
    """(part, n, bytes): how findings (key, size) cover an inventory (key, size, exact) of unique keys.

    ``classified`` are inexact keys with a finding, ``missing`` inexact keys without, ``overlap`` exact
    keys with a finding, ``exact`` exact ones without, ``untracked`` findings of no key of the
    inventory or of no key at all. Bytes are the inventory's, for untracked ones the finding's.
    """
    left = inventory.select(F.col(key), F.col(size).alias("own"), F.col(exact).alias("exact"), F.lit(True).alias("listed"))
    right = findings.select(F.col(key), F.col(size).alias("found_size"), F.lit(True).alias("found"))
    both = left.join(right, key, "full_outer")
    part = F.when(F.col("listed").isNull(), "untracked").when(F.col("exact"), F.when(F.col("found"), "overlap").otherwise("exact")).when(F.col("found"), "classified").otherwise("missing")
    return both.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("own", "found_size")).alias("bytes"))


def balance(parts: DataFrame, totals: DataFrame, unclaimed: DataFrame) -> DataFrame:
    """(inexact_bytes, reconciled_bytes, difference): a report's totals (total, matched) against what ``reconcile`` accounts for.

    Inexact bytes are those not matched; they must be classified, missing or ``unclaimed`` (bytes).
    """
    accounted = parts.where("part in ('classified', 'missing')").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("accounted"))
    outside = unclaimed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("outside"))
    one = totals.agg((F.sum("total") - F.sum("matched")).alias("inexact_bytes"))
    row = one.join(accounted).join(outside)  # one row each
    reconciled = F.col("accounted") + F.col("outside")
    return row.select("inexact_bytes", reconciled.alias("reconciled_bytes"), (F.col("inexact_bytes") - reconciled).alias("difference"))


def require_balance(balanced: DataFrame) -> DataFrame:
    """The row of ``balance``; reading it fails if the totals differ."""
    ok = F.when(F.col("difference") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("the inventories do not reconcile")).cast("boolean"))
    return balanced.where(ok)


def candidates(rows: DataFrame, wanted: DataFrame, symbol: str, unit: str, unplaced: Column, stub: Column) -> DataFrame:
    """(symbol, n, units, unplaced, stubbed): who defines each wanted symbol, and whether one copy is unplaced or a stub."""
    found = rows.join(wanted.select(symbol).distinct(), symbol, "left_semi")
    units = F.sort_array(F.collect_set(F.col(unit).cast("string")))
    return found.groupBy(symbol).agg(F.count(F.lit(1)).alias("n"), F.array_join(units, ",").alias("units"), F.bool_or(unplaced).alias("unplaced"), F.bool_or(stub).alias("stubbed"))


def placements(rows: DataFrame, address: str, symbol: str) -> DataFrame:
    """(address, symbols, n): the names placed at each address, sorted; rows without an address are at none."""
    names = F.sort_array(F.collect_set(symbol))
    return rows.where(F.col(address).isNotNull()).groupBy(address).agg(names.alias("symbols"), F.count(F.lit(1)).alias("n"))


def missing_cause(missing: DataFrame, placed: DataFrame, candidate: DataFrame, symbol: str, address: str, unmapped: Column) -> DataFrame:
    """Missing rows (symbol, address) with the first cause that holds, from ``placements`` and ``candidates``."""
    rows = missing.join(placed.select(address, "symbols"), address, "left").join(candidate.select(symbol, F.lit(True).alias("made"), "unplaced", "stubbed"), symbol, "left")
    another = F.size(F.array_remove(F.coalesce("symbols", F.array().cast("array<string>")), F.col(symbol))) > 0
    cause = (
        F.when(another, "matched-under-another-name")
        .when(F.coalesce("stubbed", F.lit(False)), "stubbed")
        .when(F.coalesce("unplaced", F.lit(False)), "compiled-but-unplaced")
        .when(F.col("made").isNotNull(), "placed-in-unit-residual-skips")
        .when(unmapped, "unmapped-target-extent")
        .otherwise("not-compiled")
    )
    return rows.withColumn("cause", cause).drop("symbols", "made", "unplaced", "stubbed")


def two_indexes(rows: DataFrame, symbol: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """(symbol, units, n) and (unit, symbols, n): the same rows by either column, as sorted sets."""

    def index(by: str, of: str, name: str) -> DataFrame:
        return rows.groupBy(by).agg(F.sort_array(F.collect_set(of)).alias(name), F.count(F.lit(1)).alias("n"))

    return index(symbol, unit, "units"), index(unit, symbol, "symbols")


def on_both(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Keys that both sides have, once each."""
    return ours.select(*key).distinct().join(theirs.select(*key).distinct(), key)


def absent(members: DataFrame, present: DataFrame, name: str, order: str) -> DataFrame:
    """(name, order): names of ``members`` that ``present`` lacks, each at its first place."""
    first = members.where(F.col(name) != "").groupBy(name).agg(F.min(order).alias(order))
    return first.join(present.select(name).distinct(), name, "left_anti")


def with_others(rows: DataFrame, names: DataFrame, key: str, new: str) -> DataFrame:
    """Rows re-keyed by ``names`` (key, new): a key without a name passes through."""
    return rows.join(names.select(key, new), key, "left").withColumn(key, F.coalesce(F.col(new).cast("string"), F.col(key).cast("string"))).drop(new)


def digests(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, sha256): a manifest of contents."""
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def manifest_faults(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(path, fault): entries of a manifest (path, sha256) that ``files`` (path, sha256) doesn't have, or has with another digest."""
    both = expected.select("path", "sha256").join(files.select("path", F.col("sha256").alias("found")), "path", "left")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("path", fault.alias("fault")).where("fault is not null")
