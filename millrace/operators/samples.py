"""Capped samples per stratum as sketches that merge: the rows of smallest hash.

Every task keeps the k rows of smallest hash of each stratum that it has seen, and nothing else; tasks'
rows meet by stratum and are cut again the same way. So no stratum is sorted or held, sketches of parts
merge into the sketch of the whole, and the same seed gives the same rows in any order of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a recorded mutation did.
EFFECTS = ["does not compile", "no effect", "beyond the function", "case"]


def drawn(key: Column, seed: int) -> Column:
    """A row's draw: sixteen digits of a hash of the seed and its key."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 16)


def _smallest(rows: DataFrame, stratum: list[str], k: int, order: list[str]) -> DataFrame:
    """At most k rows a stratum of each task, those of smallest ``order``; a task holds its sketch and a batch."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = both.sort_values(order, kind="stable").groupby(stratum, dropna=False, sort=False).head(k)
        if held is not None:
            yield held

    return rows.mapInPandas(keep, rows.schema)


def sketch(rows: DataFrame, stratum: list[str], k: int, order: list[str]) -> DataFrame:
    """The k rows of each stratum with the smallest ``order`` (a draw, then a key that no two rows share). Null strata are strata."""
    return merge([_smallest(rows, stratum, k, order)], stratum, k, order)


def merge(sketches: list[DataFrame], stratum: list[str], k: int, order: list[str]) -> DataFrame:
    """The sketch of all rows that the sketches were made of."""
    both = sketches[0]
    for more in sketches[1:]:
        both = both.unionByName(more)
    return _smallest(both.repartition(*stratum), stratum, k, order)


def effect(error: Column, exact: Column, n_lost: Column, lost_itself: Column) -> Column:
    """What a mutation of a function did to those that were exact; null where its own function wasn't."""
    what = F.when(error, "does not compile").when(n_lost == 0, "no effect").when((n_lost == 1) & lost_itself, "case").otherwise("beyond the function")
    return F.when(exact, what)


def tally(mutations: DataFrame) -> DataFrame:
    """(mutation, effect, n): a row for each effect of every mutation seen, zeros included."""
    n = mutations.groupBy("mutation").agg(*[F.count_if(F.col("effect") == e).alias(e) for e in EFFECTS])
    each = F.array(*[F.struct(F.lit(e).alias("effect"), F.col(f"`{e}`").alias("n")) for e in EFFECTS])
    return n.select("mutation", F.inline(each))


def cases(mutations: DataFrame, seed: int, per_kind: int) -> DataFrame:
    """At most ``per_kind`` cases of each mutation, at random: (unit, symbol, mutation, draw) of (unit, symbol, mutation, effect)."""
    found = mutations.where("effect = 'case'").select("unit", "symbol", "mutation", drawn(F.concat_ws("/", "unit", "symbol", "mutation"), seed).alias("draw"))
    return sketch(found, ["mutation"], per_kind, ["draw", "unit", "symbol"])


def pairs(first: DataFrame, second: DataFrame, seed: int, count: int) -> DataFrame:
    """At most ``count`` of the two-step compositions (unit, symbol, mutation, then, draw), at random.

    ``first`` and ``second`` are sketches of steps (unit, symbol, mutation); the second step is of another
    kind and goes on from the same function. One composition a function is drawn, then the sample.
    """
    then = second.select("unit", "symbol", F.col("mutation").alias("then"))
    both = first.select("unit", "symbol", "mutation").join(then, ["unit", "symbol"]).where("mutation <> then")
    both = both.withColumn("draw", drawn(F.concat_ws("/", "unit", "symbol", "mutation", "then"), seed))
    one = both.groupBy("unit", "symbol").agg(F.min(F.struct("draw", "mutation", "then")).alias("s")).select("unit", "symbol", "s.mutation", "s.then", "s.draw")
    return sketch(one.withColumn("all", F.lit(0)), ["all"], count, ["draw", "unit", "symbol"]).drop("all")
