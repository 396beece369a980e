"""Bags: differences, cancellation, pairing and set comparison per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import written

#: Rows of one key that a single task numbers; keys with more are numbered in ranges.
NUMBERED_ROWS = 1_000_000


def difference(ours: DataFrame, theirs: DataFrame, key: list[str], counts: bool = False) -> DataFrame:
    """Multiset difference both ways as counts: (key..., ours_only, theirs_only), rows with a surplus only."""
    side = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    both = side(ours, "n_ours").join(side(theirs, "n_theirs"), key, "full_outer")
    both = both.na.fill(0, ["n_ours", "n_theirs"])
    both = both.withColumn("ours_only", F.greatest(F.col("n_ours") - F.col("n_theirs"), F.lit(0))).withColumn("theirs_only", F.greatest(F.col("n_theirs") - F.col("n_ours"), F.lit(0)))
    both = both.where("ours_only + theirs_only > 0")
    return both if counts else both.drop("n_ours", "n_theirs")


def cancel(ours: DataFrame, theirs: DataFrame, stages: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Cancel rows one for one, stage by stage: rows that agree in a stage's column are removed from both sides.

    Within equal values the rows of lowest ``order`` cancel first. A null value cancels nothing. Only
    counts per value of the two sides meet; rows are numbered where their side has more.
    """
    side = lambda df, name: df.withColumn("_side", F.lit(name))
    both = side(ours, "o").unionByName(side(theirs, "t"), allowMissingColumns=True)
    for i, stage in enumerate(stages):
        own = lambda name: F.count_if(F.col("_side") == name).alias(name)
        counts = written(both.groupBy(stage).agg(own("o"), own("t")), "counts")
        most = counts.agg(F.coalesce(F.greatest(F.max("o"), F.max("t")), F.lit(0))).first()[0]
        both = _surplus(both, counts, stage, order, most > NUMBERED_ROWS)
        if i < len(stages) - 1:
            both = written(both, "surplus")
    return tuple(both.where(F.col("_side") == name).select(*df.columns) for df, name in ((ours, "o"), (theirs, "t")))


def _surplus(rows: DataFrame, counts: DataFrame, key: str, order: str, large: bool) -> DataFrame:
    """Rows of either side beyond as many as the other has of their key; ``counts`` has both sides' numbers per key. Rows without a key stay."""
    over = F.when(F.col("o") > F.col("t"), F.struct(F.lit("o").alias("_side"), F.col("t").alias("_gone"))).when(F.col("t") > F.col("o"), F.struct(F.lit("t").alias("_side"), F.col("o").alias("_gone")))
    more = counts.select(key, over.alias("over")).where("over is not null").select(key, "over.*")
    left = rows.join(more, [key, "_side"], "left").where(F.col(key).isNull() | F.col("_gone").isNotNull())
    # rows that stay whatever their number are dealt out evenly, not by their key
    spread = F.when(F.coalesce("_gone", F.lit(0)) == 0, F.xxhash64(order)).otherwise(0)
    if not large:
        ordinal = F.row_number().over(Window.partitionBy(key, "_side", spread).orderBy(order))
        left = left.withColumn("ordinal", F.when(F.coalesce("_gone", F.lit(0)) == 0, 1).otherwise(ordinal))
    else:  # a key has a surplus on one side only
        left = numbered(left, key, order, True)
    return left.where(F.col("ordinal") > F.coalesce("_gone", F.lit(0))).drop("ordinal", "_gone")


def numbered(rows: DataFrame, key: str, order: str, large: bool | None = None) -> DataFrame:
    """Rows with ``ordinal``, their place among those of their key by ``order`` (a column no two rows of a key should share).

    Keys of up to ``NUMBERED_ROWS`` rows are numbered in one window. If there are larger ones (``large``;
    counted if not given), rows are dealt into ranges of (key, order), numbered within each, and moved
    on by the rows of earlier ranges.
    """
    whole = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    if large is None:
        large = not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NUMBERED_ROWS).isEmpty()
    if not large:
        return whole
    dealt = written(rows.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range of a key
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    placed = inside.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return placed.withColumn("ordinal", (F.col("_place") + F.col("_before")).cast("int")).drop("_range", "_place", "_key", "_of", "_before")


def pair(ours: DataFrame, theirs: DataFrame, key: str, item: str) -> DataFrame:
    """Pair the n-th item of a key on one side with the n-th on the other; what is over stands alone."""
    side = lambda df, name: numbered(df.select(key, item), key, item).select(key, "ordinal", F.col(item).alias(name))
    return side(ours, "ours").join(side(theirs, "theirs"), [key, "ordinal"], "full_outer")


def symmetric_difference(ours: DataFrame, theirs: DataFrame, base: str, member: str) -> DataFrame:
    """Per base of both sides: members of one side only. Bases of one side only are not compared."""
    a, b = ours.select(base, member).distinct(), theirs.select(base, member).distinct()
    both = a.withColumn("o", F.lit(1)).join(b.withColumn("t", F.lit(1)), [base, member], "full_outer")
    out = both.groupBy(base).agg(F.count("o").alias("n_ours"), F.count("t").alias("n_theirs"), F.count_if(F.col("t").isNull()).alias("ours_only"), F.count_if(F.col("o").isNull()).alias("theirs_only"))
    return out.where("n_ours > 0 and n_theirs > 0 and ours_only + theirs_only > 0")


def same_bag(ours: DataFrame, theirs: DataFrame, unit: str, item: str) -> DataFrame:
    """Per unit of both sides: are the bags of items equal?"""
    counts = lambda df, n: df.groupBy(unit, item).agg(F.count(F.lit(1)).alias(n))
    both = counts(ours, "a").join(counts(theirs, "b"), [unit, item], "full_outer").na.fill(0, ["a", "b"])
    out = both.groupBy(unit).agg(F.bool_and(F.col("a") == F.col("b")).alias("same"), F.sum("a").alias("n_ours"), F.sum("b").alias("n_theirs"))
    return out.where("n_ours > 0 and n_theirs > 0")


def without_twins(rows: DataFrame, key: str, twin) -> DataFrame:
    """Drop a row whose twin key (an expression of its own key) is also there."""
    keys = rows.select(F.col(key).alias("other")).distinct()
    return rows.withColumn("other", twin).join(keys, "other", "left_anti").drop("other")


def distinct_first(rows: DataFrame, value: str, order: str) -> DataFrame:
    """One row per value, the one of lowest order (any of those that share value and order), with the value's number of rows.

    Grouping by a hash first keeps long values out of the shuffle's keys; a null is a value of its own.
    """
    digest = F.coalesce(F.sha2(F.col(value).cast("string"), 256), F.lit(""))
    tagged = rows.withColumn("digest", digest)
    best = tagged.groupBy("digest").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n_copies"))
    found = tagged.join(best, "digest").where(F.col(order).eqNullSafe(F.col("_first")))
    return found.drop("_first").dropDuplicates(["digest"])
