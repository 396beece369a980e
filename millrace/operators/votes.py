"""Votes, unanimity, rankings and summaries per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(rows: DataFrame, group: list[str], gain: Column, order: str) -> DataFrame:
    """Per group the row of largest positive gain; the lowest ``order`` breaks ties."""
    w = Window.partitionBy(*group).orderBy(F.col("gain").desc(), F.col(order))
    return rows.withColumn("gain", gain).where("gain > 0").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def unseen(keys: DataFrame, log: DataFrame, key: str, settings: dict) -> DataFrame:
    """Keys for which the log has no row with all of these settings (null equals null)."""
    done = F.lit(True)
    for name, value in settings.items():
        done = done & F.col(name).eqNullSafe(F.lit(value))
    return keys.join(log.where(done).select(key).distinct(), key, "left_anti")


def mode_first(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Per group the most frequent value; of equally frequent ones the first to occur."""
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "first")
    return counted.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(group, value, "n")


def weighted_vote(rows: DataFrame, group: str, choice: str, weight: Column) -> DataFrame:
    """Per group the choice of most weight, or ``ambiguous`` where several have as much."""
    tally = rows.groupBy(group, choice).agg(F.sum(weight).alias("votes"))
    best = tally.groupBy(group).agg(F.max(F.struct("votes", choice)).alias("top"), F.collect_list("votes").alias("all"))
    ties = F.size(F.filter("all", lambda v: v == F.col("top.votes")))
    return best.select(group, F.when(ties == 1, F.col(f"top.{choice}")).alias("winner"), F.col("top.votes").alias("votes"), (ties > 1).alias("ambiguous"))


def unanimous(sites: DataFrame, symbol: str, claim: str) -> DataFrame:
    """Symbols whose sites all make one claim, and whether another such symbol makes it too."""
    agreed = sites.groupBy(symbol).agg(F.min(claim).alias("claim"), F.max(claim).alias("last"), F.count(F.lit(1)).alias("n_sites")).where("claim = last").drop("last")
    rivals = agreed.groupBy("claim").agg(F.count(F.lit(1)).alias("n_claimants"))
    return agreed.join(rivals, "claim").select(symbol, "claim", "n_sites", (F.col("n_claimants") == 1).alias("proven"))


def rank_multivalue(rows: DataFrame, keys: Column, size: str) -> DataFrame:
    """For each distinct value of an array column: rows that have it and the sum of their sizes."""
    each = rows.select(F.explode(F.array_distinct(keys)).alias("key"), size)
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("total"))


def blocking(found: DataFrame, item: str, cause: str) -> DataFrame:
    """Per cause: items that it blocks, and items that it alone blocks."""
    sets = found.groupBy(item).agg(F.collect_set(cause).alias("causes"))
    each = sets.select(F.explode("causes").alias(cause), (F.size("causes") == 1).alias("alone"))
    return each.groupBy(cause).agg(F.count(F.lit(1)).alias("n_blocked"), F.count_if("alone").alias("n_alone"))


def construct_rank(sites: DataFrame, construct: str, function: str, size: str) -> DataFrame:
    """Per construct: sites, distinct functions and the functions' sizes, each function counted once."""
    once = sites.groupBy(construct, function).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    return once.groupBy(construct).agg(F.sum("n").alias("n_sites"), F.count(F.lit(1)).alias("n_functions"), F.sum("size").alias("total_size"))


def exact_sets(rows: DataFrame, symbol: str, setting: str, exact: Column, baseline: Column, n_settings: int) -> DataFrame:
    """Per symbol the settings at which it is exact: locked (some, not the baseline), witness (the baseline, not all)."""
    per = rows.groupBy(symbol, setting).agg(F.bool_and(exact).alias("exact"), F.first(baseline).alias("base"))
    out = per.groupBy(symbol).agg(F.count_if("exact").alias("n_exact"), F.bool_or(F.col("exact") & F.col("base")).alias("at_base"))
    kind = F.when(F.col("n_exact") == 0, "never").when(~F.col("at_base"), "locked").when(F.col("n_exact") < n_settings, "witness").otherwise("always")
    return out.withColumn("kind", kind)


def variant_audit(rows: DataFrame, key: str, exact: dict[str, Column], baseline: str) -> DataFrame:
    """For each variant: keys exact, and keys lost and gained against the baseline."""
    flags = rows.select(key, *[c.alias(n) for n, c in exact.items()])
    sums = [F.struct(F.lit(n).alias("variant"), F.count_if(n).alias("n_exact"), F.count_if(F.col(baseline) & ~F.col(n)).alias("n_lost"), F.count_if(~F.col(baseline) & F.col(n)).alias("n_gained")) for n in exact]
    return flags.agg(F.array(*sums).alias("v")).select(F.inline("v"))


def bench_table(outcomes: DataFrame, kind: str, solved: Column, cost: Column) -> DataFrame:
    """Per kind: cases, solved, mean cost and mean cost of the solved."""
    return outcomes.groupBy(kind).agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(solved).alias("n_solved"), F.avg(cost).alias("mean_cost"), F.avg(F.when(solved, cost)).alias("mean_solved_cost"))


def location_table(found: DataFrame, kind: str, distance: Column, share: Column) -> DataFrame:
    """Per kind: pointed at all, on the line, within two, and mean share."""
    return found.groupBy(kind).agg(F.count(distance).alias("n_pointed"), F.count_if(distance == 0).alias("n_on_line"), F.count_if(distance <= 2).alias("n_within_two"), F.avg(share).alias("mean_share"))


def capped_sample(rows: DataFrame, group: str, key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows per group, by the order of a seeded hash (a sampling operator: its limit is its purpose)."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
