"""Runs of a parameter sweep, compared by digests of their prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(rows: DataFrame, unit: str, run: str, order: str, values: list[str], accepted: Column) -> DataFrame:
    """(unit, before, after, n_before, n_after, common, extends, n_accepted, at): every run of a unit against the one before it.

    A row's digest is that of all rows of its run up to it, two 64-bit sums of hashes of place and
    value; so two runs agree up to a place where their digests at that place do, and ``common`` is the
    last such place. ``extends`` if that is the whole of the earlier run and it is not empty; then
    ``n_accepted`` counts accepted rows beyond it, and ``at`` is the place of the only one. Rows are
    shuffled once, by unit: all windows and groups are within it.
    """
    in_run = Window.partitionBy(unit, run).orderBy(order)
    upto = in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.select(unit, run, order, *values, F.coalesce(accepted, F.lit(False)).alias("ok")).repartition(unit)
    placed = dealt.withColumn("place", F.row_number().over(in_run))
    hashed = [F.xxhash64(F.lit(salt), "place", F.to_json(F.struct(*values), {"ignoreNullFields": "false"})) for salt in (0, 1)]
    digests = F.struct(*[F.bit_xor(h).over(upto).alias(f"d{i}") for i, h in enumerate(hashed)])
    sized = placed.select(unit, run, "place", "ok", digests.alias("digest"), F.count(F.lit(1)).over(Window.partitionBy(unit, run)).alias("n"))
    sized = sized.withColumn("number", F.dense_rank().over(Window.partitionBy(unit).orderBy(run)))
    # what the run before has at the same place, and what that run is
    here = Window.partitionBy(unit, "place").orderBy("number")
    met = sized.withColumn("other", F.when(F.lag("number").over(here) == F.col("number") - 1, F.lag("digest").over(here)))
    per = met.groupBy(unit, run, "number", "n").agg(
        F.coalesce(F.max(F.when(F.col("other") == F.col("digest"), F.col("place"))), F.lit(0)).alias("common"),
        F.count_if(F.col("ok") & F.col("other").isNull()).alias("n_accepted"),
        F.min(F.when(F.col("ok") & F.col("other").isNull(), F.col("place"))).alias("at"),
    )
    w = Window.partitionBy(unit).orderBy("number")
    per = per.select(unit, F.lag(run).over(w).alias("before"), F.col(run).alias("after"), F.lag("n").over(w).alias("n_before"), F.col("n").alias("n_after"), F.col("common").cast("long").alias("common"), "n_accepted", "at").where("n_before is not null")
    extends = F.col("common") == F.col("n_before")
    one = F.when(extends & (F.col("n_accepted") == 1), F.col("at").cast("long"))
    return per.select(unit, "before", "after", "n_before", "n_after", "common", extends.alias("extends"), F.when(extends, F.col("n_accepted")).otherwise(0).alias("n_accepted"), one.alias("at"))
