"""Levels at which two values agree, and rewrites of texts, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agree_level(ours: Column, theirs: Column, levels: list[tuple[str, callable]]) -> Column:
    """Name of the first level at which two values agree, from strict to loose; null at none."""
    out = F.lit(None).cast("string")
    for name, view in reversed(levels):
        out = F.when(view(ours).eqNullSafe(view(theirs)), name).otherwise(out)
    return out


def agreeing_pairs(rows: DataFrame, levels: list[tuple[str, Column]]) -> DataFrame:
    """(level, n_pairs): of all pairs of rows, how many first agree at each level, from strict to loose.

    A level is a key that equal rows of the stricter levels share too. Pairs are counted from the sizes
    of classes, never listed: a class of n rows has n (n - 1) / 2.
    """
    names = [name for name, _ in levels]
    sizes = rows.select(*[key.alias(name) for name, key in levels]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for i, name in enumerate(names):
        at = sizes.groupBy(*names[i:]).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
        row = at.select(F.lit(i).alias("i"), F.lit(name).alias("level"), "pairs")
        out = row if out is None else out.union(row)
    stricter = out.select((F.col("i") + 1).alias("i"), F.col("pairs").alias("before"))  # a row a level
    counted = out.join(stricter, "i", "left").select("level", (F.col("pairs") - F.coalesce("before", F.lit(0))).cast("long").alias("n_pairs"))
    return counted.where("n_pairs > 0")


def rewrites(rows: DataFrame, key: str, text: str) -> DataFrame:
    """0..n rewrites of each row: (key, kind, line, result). A rewrite swaps two adjacent lines that differ, or joins a line with the next.

    Rows of rewrites name the line (from 0) that they begin at; ``result`` is only built where it is
    used. A null or one-line text has none.
    """
    lines = rows.select(key, F.split(text, "\n").alias("lines")).where(F.size("lines") > 1)
    each = lines.select(key, "lines", F.explode(F.sequence(F.lit(1), F.size("lines") - 1)).alias("i"))
    here, there = F.get("lines", F.col("i") - 1), F.get("lines", F.col("i"))
    around = lambda middle: F.array_join(F.concat(F.slice("lines", F.lit(1), F.col("i") - 1), middle, F.slice("lines", F.col("i") + 2, F.size("lines"))), "\n")
    row = lambda kind, middle: F.struct(F.lit(kind).alias("kind"), around(middle).alias("result"))
    swap = F.when(here != there, row("swap", F.array(there, here)))
    both = F.array_compact(F.array(swap, row("join", F.array(F.concat(here, F.lit(" "), there)))))
    return each.select(key, (F.col("i") - 1).alias("line"), F.inline(both)).select(key, "kind", "line", "result")
