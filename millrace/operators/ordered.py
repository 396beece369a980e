"""Ordered rows: as-of lookups, spans, islands, running sums, continuity and change history.

Every window is partitioned by a key of the data, never global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_last(rows: DataFrame, key: str, order: list[str], wanted: Column, value: str) -> DataFrame:
    """Each row with the value of the latest earlier row of its key that is wanted (null if none)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("earlier", F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w))


def next_span(rows: DataFrame, key: str, order: list[str], start: str, sentinel: Column) -> DataFrame:
    """Each row's span ends where the next row of its key starts; the last ends at the sentinel."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("span_end", F.lead(start).over(w)).withColumn("span_end", F.coalesce("span_end", sentinel))


def islands(rows: DataFrame, key: str, number: Column) -> DataFrame:
    """Runs of consecutive integers per key: first, last and length."""
    each = rows.select(key, number.alias("number")).distinct()
    w = Window.partitionBy(key).orderBy("number")
    each = each.withColumn("island", F.col("number") - F.row_number().over(w))
    return each.groupBy(key, "island").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("length")).drop("island")


def spans_text(found: DataFrame, key: str) -> DataFrame:
    """Islands per key as text such as ``3-5, 9``, in order."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("first", text.alias("text")))), lambda x: x["text"])
    return found.groupBy(key).agg(F.array_join(parts, ", ").alias("spans"), F.count(F.lit(1)).alias("n_islands"), F.max("length").alias("longest"))


def continuity(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Rows whose number is not the previous one plus 1 (the first must be 0), with what was expected."""
    w = Window.partitionBy(key).orderBy(number)
    out = rows.withColumn("expected", F.coalesce(F.lag(number).over(w) + 1, F.lit(0).cast("long")))
    return out.where(F.col(number) != F.col("expected"))


def since_reset(rows: DataFrame, key: str, order: list[str], reset: Column) -> DataFrame:
    """Per key: how many rows of each session, a session beginning after each reset row; and its bounds."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("session", F.coalesce(F.sum(F.when(reset, 1).otherwise(0)).over(before), F.lit(0)).cast("long"))


def running_budget(rows: DataFrame, key: str, order: list[str], change: Column) -> DataFrame:
    """Running sum of an integer change per key, and the smallest it has been so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("running", F.sum(change.cast("long")).over(w))
    return out.withColumn("lowest", F.min("running").over(w))


def change_history(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows at which the value differs from the key's previous row, with the previous value; the first row is no change."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumn("previous", F.lag(value).over(w)).withColumn("ordinal", F.row_number().over(w))
    return out.where((F.col("ordinal") > 1) & ~F.col("previous").eqNullSafe(F.col(value)))


def decisions(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the first and the last change."""
    value = F.struct(order, "previous", "value")
    return changes.groupBy(key).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n_changes"))


def pieces(rows: DataFrame, key: str, order: list[str], ends: Column) -> DataFrame:
    """Number the pieces of each key's rows; a piece ends with a row that ``ends``."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("piece", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)).cast("long"))


def look_ahead(rows: DataFrame, key: str, order: list[str], wanted: Column, within: int) -> DataFrame:
    """Does a wanted row follow within so many rows of the key?"""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1, within)
    return rows.withColumn("follows", F.coalesce(F.max(F.when(wanted, 1).otherwise(0)).over(w), F.lit(0)) == 1)


def size_runs(rows: DataFrame, key: str, order: list[str], value: str, pattern: list) -> DataFrame:
    """Where a sequence of values begins in a key's ordered rows, and how much of it agrees there.

    A place counts if more than half of the pattern agrees; the best of a key (the first on ties) is returned.
    """
    w = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("at", F.row_number().over(w))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("offset"), F.lit(v).alias("want")) for i, v in enumerate(pattern)]))
    hits = placed.select(key, "at", value, wanted.alias("p")).where(F.col(value) == F.col("p.want"))
    starts = hits.groupBy(key, (F.col("at") - F.col("p.offset")).alias("start")).agg(F.count(F.lit(1)).alias("score")).where((F.col("start") >= 1) & (2 * F.col("score") > len(pattern)))
    best = starts.groupBy(key).agg(F.max(F.struct("score", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(key, (-F.col("best.back")).alias("start"), F.col("best.score").alias("score"))
