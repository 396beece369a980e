"""Candidates measured over all that depends on them, with a memo of what was measured before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import written

#: A measurement is named by the contents it was made of.
MEMO = "digest string, symbol string, score double, exact boolean"


def digest(*contents: Column) -> Column:
    """The name of a measurement of these contents."""
    return F.sha2(F.concat_ws("/", *[F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256) for c in contents]), 256)


def measured(wanted: DataFrame, memo: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """MEMO rows of all that is ``wanted`` (digest, ...), and the rows that were new.

    What the memo knows is looked up; only the rest, each digest once, goes to ``evaluate``, which gives
    MEMO rows. A measurement without any symbol is kept as one row of a null symbol, so it is known too.
    """
    keys = written(wanted.select("digest").distinct(), "keys")
    fresh = written(wanted.join(keys.join(memo.select("digest").distinct(), "digest", "left_anti"), "digest").dropDuplicates(["digest"]), "fresh")
    if fresh.isEmpty():
        new = memo.limit(0)
    else:
        found = evaluate(fresh).select("digest", "symbol", "score", "exact")
        new = written(fresh.select("digest").join(found, "digest", "left"), "measured")
    known = memo.join(keys, "digest", "left_semi").select("digest", "symbol", "score", "exact")
    return known.unionByName(new), new


def counterfactual(candidates: DataFrame, dependents: DataFrame, memo: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What each candidate text of a header does to every unit that includes it, and the memo's new rows.

    ``candidates`` is (header, candidate, content) with one row of a null candidate for the header as it
    is, ``dependents`` (header, unit, content). Every candidate is measured with every dependent unit, by
    the contents of both; a known pair is looked up. The result is (header, candidate, n_units, n_lost,
    n_gained, n_changed, n_worse, n_failed): symbols exact before and not after, the other way
    round, of another score, of a lower score, and units without a measurement. A symbol that is gone scores 0.
    A unit that has no measurement with the header as it is fails the call.
    """
    units = dependents.select("header", "unit", F.col("content").alias("_unit"))
    trials = candidates.join(units, "header").select("header", "candidate", "unit", digest(F.col("content"), F.col("_unit")).alias("digest"), F.col("content").alias("candidate_content"), F.col("_unit").alias("unit_content"))
    trials = written(trials, "trials")
    results, new = measured(trials, memo, evaluate)
    rows = trials.select("header", "candidate", "unit", "digest").join(results, "digest")
    unmeasured = rows.where("candidate is null and symbol is null").select(F.raise_error(F.concat(F.lit("no measurement as it is: "), F.col("unit").cast("string"))).cast("string").alias("e"))
    unmeasured.collect()  # fails at the first, has no rows otherwise
    before = rows.where("candidate is null").select("header", "unit", "symbol", F.col("score").alias("b"), F.coalesce("exact", F.lit(False)).alias("eb")).where("symbol is not null")
    tried = written(trials.where("candidate is not null").select("header", "candidate", "unit", "digest"), "tried")
    after = tried.join(results, "digest")
    failed = after.where("symbol is null").select("header", "candidate", "unit")
    fine = tried.select("header", "candidate", "unit").join(failed, ["header", "candidate", "unit"], "left_anti")
    have = after.where("symbol is not null").select("header", "candidate", "unit", "symbol", F.col("score").alias("a"), "exact")
    old = fine.join(before, ["header", "unit"])
    both = old.join(have, ["header", "candidate", "unit", "symbol"], "full_outer")
    eb, ea = F.coalesce("eb", F.lit(False)), F.coalesce("exact", F.lit(False))
    a = F.coalesce("a", F.lit(0.0))
    known = F.col("b").isNotNull()
    deltas = both.groupBy("header", "candidate").agg(F.count_if(eb & ~ea).alias("n_lost"), F.count_if(ea & ~eb).alias("n_gained"), F.count_if(known & (a != F.col("b"))).alias("n_changed"), F.count_if(known & (a < F.col("b"))).alias("n_worse"))
    sizes = tried.groupBy("header", "candidate").agg(F.count(F.lit(1)).alias("n_units"))
    fails = failed.groupBy("header", "candidate").agg(F.count(F.lit(1)).alias("n_failed"))
    out = sizes.join(deltas, ["header", "candidate"], "left").join(fails, ["header", "candidate"], "left")
    return out.na.fill(0, ["n_lost", "n_gained", "n_changed", "n_worse", "n_failed"]), new
