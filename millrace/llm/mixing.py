"""Mixing sources to target weights: hash-random order within a source, prefix sums, a cut at its budget.

A document's place in its source's order is a hash of its id and text, so reruns and other clusters
give the same mix. The hash is dealt into ranges by its first digits; the sizes of ranges are summed
in tasks, their prefix sums are over a row a range, and only the one range of a source that holds the
cut has to be sorted and summed row by row. So a source with a third of all rows is spread over all
ranges, and no task sees a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Hexadecimal digits of a key, and how many of them name its range (16 ** 3 ranges a source).
KEY, RANGE = 16, 3
#: What names a source: whether it is null, and its value.
SOURCE = ["none", "name"]


def sized(docs: DataFrame, source: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, none, name, key, range, size): words of the text, and the row's random key within its source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id, F.lit(":"), text).cast("binary")), 1, KEY)
    size = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    name = F.col(f"`{source}`").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"), key.alias("key"), size.alias("size"))
    return rows.withColumn("range", F.substring("key", 1, RANGE))


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(none, name, source_size, target) of (none, name, source_size), one row a source.

    Sources by code point, null last, take the weights in turn and share the total of all sizes. A
    target stops at ``most`` times its source; the excess goes to the others by weight until none is
    above. That ends at one level: sources with the smallest ratio of size to weight are full, the rest
    share what these leave by weight. So one pass in the order of this ratio finds it, in exact integers.
    """
    whole = lcm(*weights)
    number = (F.row_number().over(Window.orderBy(*SOURCE)) - 1) % len(weights) + 1  # a row a source: one task
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), number)
    rows = sources.select(*SOURCE, "source_size", pick(weights).alias("weight"), pick([whole // w for w in weights]).alias("turns"))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("source_size") * F.col("turns"), *SOURCE)
    every = Window.partitionBy()
    rows = rows.select(
        "*",
        F.row_number().over(by_ratio).alias("place"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("share"),
    )
    product = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    open_ = F.when(product("weight", "left") <= product("cap", "share"), F.struct("place", "left", "share"))
    rows = rows.withColumn("open", open_).withColumn("level", F.min("open").over(every))
    part = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.share")
    full = F.col("place") < F.col("level.place")
    return rows.select(*SOURCE, "source_size", F.when(full, F.col("cap").cast("double")).otherwise(part).alias("target"))


def mix(docs: DataFrame, source: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, name, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A source whose target is several times its size is taken whole as often as that fits; of the next
    epoch the documents before the cut are taken, and of the one at the cut as many words as complete the
    budget, the whole part of the target. So the taken words of a source are its budget exactly, and none
    is taken more than ``most`` times. A null text has no words; a null source is a source of its own,
    the last; rows without an id are ordered by their text; of rows that repeat id and text any may be
    the one at the cut, which leaves the same result; an empty table gives an empty one. ``name`` is
    null for the null source.
    """
    rows = C.materialise(sized(docs, source, seed), "sized")
    ranges = C.materialise(rows.groupBy(*SOURCE, "range").agg(F.sum("size").alias("size")), "ranges")
    aims = targets(ranges.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")), weights, most)
    budget, source_size = F.floor("target"), F.col("source_size")
    epochs = F.when(source_size > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    aims = aims.select(*SOURCE, "source_size", "target", epochs.alias("epochs"), (budget - epochs * source_size).alias("rest"))
    earlier = Window.partitionBy(*SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** RANGE rows a source
    ranges = ranges.withColumn("open", F.col("size") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    ranges = ranges.join(aims, SOURCE).withColumn("open", F.col("rest") - F.col("open") + F.col("size"))  # words that are still to be taken at its beginning
    ranges = ranges.withColumn("inside", F.col("open") >= F.col("size")).withColumn("cut", (F.col("open") > 0) & ~F.col("inside"))
    ranges = C.materialise(ranges.drop("size", "rest"), "cuts")
    placed = rows.join(C.bounded_broadcast(ranges, 200_000), [*SOURCE, "range"])
    whole = placed.where("not cut").withColumn("extra", F.when(F.col("inside"), F.col("size")).otherwise(0))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*SOURCE).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = placed.where("cut").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("open") - before)))
    out = whole.unionByName(cut)
    name = F.when(~F.col("none"), F.col("name")).alias("name")
    return out.select("doc_id", name, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
