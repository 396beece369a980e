"""Interaction of filters: what each removes at each place of each order, by wide packed counters.

A document's mask says which filters it fails. For one mask the outcome of all steps of all orders
is fixed: in an order, the first filter that it fails removes it. These outcomes are the fields of one
big integer, one field a (order, step); the integers of a part's documents are summed, and the sum's
fields are the counts of all steps at once. A field has as many bits as a row count, so none
overflows into the next. Documents of one mask are counted before their integer is added as often,
so a part sums at most 2 ** filters integers of each kind, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Bits of a field; counts are Spark longs, so their sums fit.
FIELD = 64
#: The filters on a text by letter: True where it fails. E, copies, looks at the whole table.
COPIES = "E"


def words(text: Column) -> Column:
    """Maximal runs of other characters than space, tab and line breaks."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_filters(text: Column, found: Column) -> dict[str, Column]:
    """Letter to failure condition of a text with words ``found``: few words, few distinct ones, many capitals, symbols."""
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, filters failed (bit i is the i-th letter) and labels.

    Copies are found without a join of texts: rows are counted by digest of the text and all else that
    is asked of them, each with its smallest id and how many rows have it; of the few rows of a digest
    the smallest id of all is then known. A text that a third of all rows share is folded in each
    task before the shuffle. A null text is empty, a null part is ''; a row without an id is neither a
    copy nor has copies, and no label; of several labels of an id any 1 counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", words(F.col("text")))
    mask = reduce(Column.__add__, [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_filters(F.col("text"), F.col("words")).values())])
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = C.materialise(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "masks")

    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    no = F.lit(False)
    kinds = named.select("doc_id", "digest", "part", "mask", "n", F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    kinds = kinds.groupBy("digest", "part", "mask", "good", "toxic")
    kinds = kinds.agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts"))
    alone = F.when(F.col("first") == F.min("first").over(Window.partitionBy("digest")), F.col("firsts")).otherwise(0)
    kinds = kinds.select("part", "mask", "good", "toxic", "n", alone.alias("alone"))
    copy = 1 << len(text_filters(F.lit(""), F.array()))
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("alone").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))
    kinds = kinds.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    nameless = rows.where("doc_id is null").select("part", no.alias("good"), no.alias("toxic"), "mask", "n")
    return kinds.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def outcomes(filters: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """All orders of that many filters, and for each mask the integer whose field order * filters + step is 1 where it is removed."""
    orders = list(permutations(range(filters)))
    packed = []
    for mask in range(1 << filters):
        at = [next((step for step, f in enumerate(order) if mask >> f & 1), None) for order in orders]
        packed.append(sum(1 << FIELD * (i * filters + step) for i, step in enumerate(at) if step is not None))
    return orders, packed


def unpacked(total: int, fields: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(fields * FIELD // 8, "little"), "<i8")


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(counts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """STEPS: a row for every part, order and step, from (part, mask, good, toxic, n); at most 2 ** (filters + 2) rows of a part meet."""
    k = len(letters)

    def audit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        orders, packed = outcomes(k)
        fields = len(orders) * k
        masks, n = rows["mask"].to_numpy(), rows["n"].to_numpy()
        total = lambda which: unpacked(sum(int(c) * packed[m] for m, c in zip(masks[which], n[which])), fields)
        removed, good, toxic = (total(which) for which in (np.ones(len(n), bool), rows["good"].to_numpy(), rows["toxic"].to_numpy()))
        which = np.array(orders).ravel()  # the filter of every field
        fails = np.array([n[masks >> f & 1 == 1].sum() for f in range(k)], np.int64)
        only = np.array([n[masks == 1 << f].sum() for f in range(k)], np.int64)
        shapley = np.array([removed[which == f].sum() for f in range(k)], np.int64)
        kept = n.sum() - np.cumsum(removed.reshape(-1, k), axis=1).ravel()
        names = np.repeat(["".join(letters[f] for f in order) for order in orders], k)
        return pd.DataFrame(
            {
                "part": key[0],
                "filter_order": names,
                "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
                "kept": kept,
                "removed": removed,
                "redundant": fails[which] - removed,
                "unique_fails": only[which],
                "good_lost": good,
                "toxic_lost": toxic,
                "shapley": shapley[which],
            }
        )

    return counts.groupBy("part").applyInPandas(audit, STEPS)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """STEPS of the filters A to E over ``docs`` (doc_id, text, part), with ``labels`` (doc_id, quality, toxic).

    Texts are read whole, however long. An empty table has no part and gives no row; rows that repeat
    id and text count each, and are no copies of one another; other columns are left alone.
    """
    letters = [*text_filters(F.lit(""), F.array()), COPIES]
    return interactions(failures(docs, labels, part), letters)
