"""Keyed snapshots: differences, acceptance gates and three-way merges.

A snapshot has one row per key with ``unit``, ``score`` (0..100, null if unknown), ``exact`` and
``size``. Functions take and return DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = ["unit", "score", "exact", "size"]


def _sides(before: DataFrame, after: DataFrame, key: str, values: list[str], how: str) -> DataFrame:
    left = before.select(key, F.lit(True).alias("in_before"), *[F.col(v).alias(f"{v}_before") for v in values])
    right = after.select(key, F.lit(True).alias("in_after"), *[F.col(v).alias(f"{v}_after") for v in values])
    out = left.join(right, key, how)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_before", "in_after")})


def worse() -> Column:
    """Absent before is never worse; absent after always is; else exactness lost or a lower score."""
    lost = F.coalesce(F.col("exact_before"), F.lit(False)) & ~F.coalesce(F.col("exact_after"), F.lit(False))
    lower = F.coalesce("score_after", F.lit(0.0)) < F.coalesce("score_before", F.lit(0.0))
    return F.when(~F.col("in_before"), False).when(~F.col("in_after"), True).otherwise(lost | lower)


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changed keys of either snapshot, with both sides and ``worse``."""
    both = _sides(before, after, key, VALUES, "full_outer")
    same = F.lit(True)
    for v in ("score", "exact"):
        same = same & F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after"))
    return both.where(~same | (F.col("in_before") != F.col("in_after"))).withColumn("worse", worse())


def net_gate(changes: DataFrame) -> DataFrame:
    """Per unit of changed keys: rejected if a loss has no size, if an exact key is lost, or if the net is not positive.

    Units without any worse key are accepted untested. The net weighs score changes by size.
    """
    c = changes.withColumn("unit", F.coalesce("unit_before", "unit_after")).withColumn("size", F.coalesce("size_after", "size_before"))
    delta = (F.coalesce("score_after", F.lit(0.0)) - F.coalesce("score_before", F.lit(0.0))).cast("decimal(18,9)")
    gates = c.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_changed"),
        F.count_if("worse").alias("n_worse"),
        F.count_if(F.col("size").isNull()).alias("n_unsized"),
        F.count_if(F.col("worse") & F.coalesce("exact_before", F.lit(False)) & ~F.coalesce("exact_after", F.lit(False))).alias("n_lost"),
        F.sum((F.col("size").cast("decimal(18,2)") * delta).cast("decimal(38,11)")).alias("net"),
    )
    reason = (
        F.when(F.col("n_worse") == 0, "no loss").when(F.col("n_unsized") > 0, "unsized").when(F.col("n_lost") > 0, "lost exact").when(F.coalesce("net", F.lit(0)) <= 0, "net not positive").otherwise("net positive")
    )
    return gates.withColumn("reason", reason).withColumn("accepted", F.col("reason").isin("no loss", "net positive"))


def lowered(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of ``before`` whose score fell; a missing key scores 0."""
    both = _sides(before, after, key, ["score"], "left")
    both = both.select(key, F.coalesce("score_before", F.lit(0.0)).alias("score_before"), F.coalesce("score_after", F.lit(0.0)).alias("score_after"))
    return both.where("score_after < score_before")


def net_gain(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per unit of ``before``: size-weighted score change."""
    both = _sides(before, after, key, VALUES, "left")
    delta = (F.coalesce("score_after", F.lit(0.0)) - F.coalesce("score_before", F.lit(0.0))).cast("decimal(18,9)")
    return both.groupBy(F.col("unit_before").alias("unit")).agg(F.sum((F.col("size_before").cast("decimal(18,2)") * delta).cast("decimal(38,11)")).alias("gain"), F.count(F.lit(1)).alias("n_keys"))


def regressed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys missing after, no longer exact, or lower, with which of the three (in this order)."""
    both = _sides(before, after, key, VALUES, "left")
    how = (
        F.when(~F.col("in_after"), "missing")
        .when(F.coalesce("exact_before", F.lit(False)) & ~F.coalesce("exact_after", F.lit(False)), "lost")
        .when(F.coalesce("score_after", F.lit(0.0)) < F.coalesce("score_before", F.lit(0.0)), "lower")
    )
    return both.select(key, F.col("unit_before").alias("unit"), how.alias("how")).where("how is not null")


def moved(base: DataFrame, variant: DataFrame, key: str, epsilon: float) -> DataFrame:
    """Keys of both whose score moved by more than ``epsilon`` or whose exactness changed."""
    both = _sides(base, variant, key, VALUES, "inner")
    both = both.withColumn("delta", F.coalesce("score_after", F.lit(0.0)) - F.coalesce("score_before", F.lit(0.0)))
    return both.where((F.abs("delta") > epsilon) | ~F.col("exact_before").eqNullSafe(F.col("exact_after")))


def holds(moves: DataFrame, target: Column) -> DataFrame:
    """Per unit: is a target key raised, and is nothing broken?"""
    raised = F.bool_or(target & (F.col("delta") > 0))
    broken = F.count_if((F.col("delta") < 0) | (F.coalesce("exact_before", F.lit(False)) & ~F.coalesce("exact_after", F.lit(False))))
    out = moves.groupBy(F.col("unit_before").alias("unit")).agg(raised.alias("raised"), broken.alias("n_broken"))
    return out.withColumn("holds", F.col("raised") & (F.col("n_broken") == 0))


def exact_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per unit of ``before``: exact keys lost and gained, and keys whose score changed."""
    both = _sides(before, after, key, VALUES, "left")
    was, now = (F.coalesce(f"exact_{s}", F.lit(False)) for s in ("before", "after"))
    return both.groupBy(F.col("unit_before").alias("unit")).agg(
        F.count_if(was & ~now).alias("n_lost"), F.count_if(~was & now).alias("n_gained"), F.count_if(F.col("in_after") & ~F.col("score_before").eqNullSafe(F.col("score_after"))).alias("n_rescored")
    )


def preserves(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per unit: every exact key stays exact and no score falls."""
    both = _sides(before, after, key, VALUES, "left")
    lost = F.coalesce("exact_before", F.lit(False)) & ~F.coalesce("exact_after", F.lit(False))
    falls = F.coalesce("score_after", F.lit(0.0)) < F.coalesce("score_before", F.lit(0.0))
    return both.groupBy(F.col("unit_before").alias("unit")).agg((~F.bool_or(lost)).alias("keeps_exact"), (~F.bool_or(falls)).alias("keeps_scores"), F.bool_and("in_after").alias("keeps_keys"))


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Each key's merged values with ``status``: same, ours, theirs, both, deleted or conflict.

    A side that equals the base gives way to the other; two sides that agree are taken; anything
    else is a conflict, and so is an edit against a deletion.
    """
    packed = lambda df, name: df.select(key, F.struct(*values).alias(name))
    all3 = packed(base, "b").join(packed(ours, "o"), key, "full_outer").join(packed(theirs, "t"), key, "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    same = lambda x, y: x.eqNullSafe(y)
    merged = F.when(same(o, t) | same(b, t), o).when(same(b, o), t)
    gone = (same(o, t) | same(b, t)) & o.isNull() | same(b, o) & ~same(b, t) & t.isNull()
    status = (
        F.when(~same(o, t) & ~same(b, t) & ~same(b, o), "conflict").when(gone, "deleted").when(same(b, o) & same(b, t), "same").when(same(o, t), "both").when(same(b, t), "ours").otherwise("theirs")
    )
    out = all3.withColumn("merged", merged).withColumn("status", status)
    return out.select(key, *[F.col(f"merged.{v}").alias(v) for v in values], "status")


def clashes(rows: DataFrame, address: str, key: str) -> DataFrame:
    """Addresses that more than one key claims."""
    return rows.where(F.col(address).isNotNull()).groupBy(address).agg(F.count_distinct(key).alias("n_keys"), F.min(key).alias("first_key")).where("n_keys > 1")
