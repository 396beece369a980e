"""Smaller record operators: selections with dedupe, lookups in order, alignment by ordinal, renamings and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import bags


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by order."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def first_present(keys: DataFrame, key: str, lookups: list[DataFrame], value: str, missing: Column | None = None) -> DataFrame:
    """Each key's value from the first lookup that has one; ``missing`` is a value that counts as none."""
    out, found = keys, []
    for i, table in enumerate(lookups):
        name = f"found_{i}"
        v = F.col(value) if missing is None else F.nullif(F.col(value), missing)
        out = out.join(table.select(key, v.alias(name)), key, "left")
        found.append(F.col(name))
    source = F.lit(None).cast("int")
    for i in reversed(range(len(found))):
        source = F.when(found[i].isNotNull(), i).otherwise(source)
    return out.select(key, F.coalesce(*found).alias(value), source.alias("source"))


def first_disagreement(ours: DataFrame, theirs: DataFrame, table: str, slot: str, value: str) -> DataFrame:
    """Per table of both sides the lowest slot with different values; an unknown (null) value agrees with any."""
    both = ours.select(table, slot, F.col(value).alias("ours")).join(theirs.select(table, slot, F.col(value).alias("theirs")), [table, slot])
    return both.where("ours <> theirs").groupBy(table).agg(F.min(F.struct(slot, "ours", "theirs")).alias("at"), F.count(F.lit(1)).alias("n_different")).select(table, f"at.{slot}", "at.ours", "at.theirs", "n_different")


def align_by_ordinal(ours: DataFrame, theirs: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows of a group side by side by their place, for groups of the same size on both sides."""
    w = Window.partitionBy(group).orderBy(*order)
    whole = Window.partitionBy(group)
    side = lambda df, name: df.select(group, F.row_number().over(w).alias("place"), F.count(F.lit(1)).over(whole).alias("size"), F.col(value).alias(name))
    return side(ours, "ours").join(side(theirs, "theirs"), [group, "place", "size"])


def renaming(pairs: DataFrame, group: str, ours: str, theirs: str) -> DataFrame:
    """Per group: is the mapping one to one in both directions, and how many names change? A null is a name of its own."""
    d = pairs.select(group, ours, theirs).distinct()
    names = lambda c: F.size(F.collect_set(F.struct(c)))
    out = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), names(ours).cast("long").alias("n_names"), names(theirs).alias("n_others"), F.count_if(F.col(ours) != F.col(theirs)).alias("n_changed"))
    return out.select(group, ((F.col("n") == F.col("n_names")) & (F.col("n") == F.col("n_others"))).alias("consistent"), "n_names", "n_changed")


def swaps(claims: DataFrame, name: str, other: str, agrees: Column) -> DataFrame:
    """Pairs (a, b) that are each other's only claim, every observation of both agreeing."""
    per = claims.groupBy(name).agg(F.min(other).alias(other), F.max(other).alias("last"), F.bool_and(agrees).alias("sure")).where(f"{other} = last and sure").drop("last", "sure")
    back = per.select(F.col(other).alias(name), F.col(name).alias("back"))
    return per.join(back, name).where(f"back = {other} and {name} < {other}").select(name, other)


def merge_by_key(found: DataFrame, key: list[str], unit: str) -> DataFrame:
    """Findings of one composite key merged, with the units that have it, sorted, as text."""
    units = F.array_join(F.sort_array(F.collect_set(F.col(unit).cast("string"))), ",")
    return found.groupBy(*key).agg(units.alias("units"), F.count(F.lit(1)).alias("n"))


def note(rows: DataFrame, group: str, name: str, most: int = 3) -> DataFrame:
    """Text ``n: a, b, c`` with up to ``most`` names, or only the number beyond that."""
    per = rows.groupBy(group).agg(F.sort_array(F.collect_set(name)).alias("names"))
    n = F.size("names")
    return per.select(group, F.when(n <= most, F.concat(n.cast("string"), F.lit(": "), F.array_join("names", ", "))).otherwise(n.cast("string")).alias("note"))


def best_setting(rows: DataFrame, setting: str, exact: Column, cost: Column) -> DataFrame:
    """The setting with most exact rows; least cost, then the smallest setting, on ties."""
    per = rows.groupBy(setting).agg(F.count_if(exact).alias("n_exact"), F.sum(cost).alias("cost"))
    return per.orderBy(F.desc("n_exact"), "cost", setting).limit(1)


def search_steps(evaluations: DataFrame, unit: str, order: list[str], score: str, allowed: Column) -> DataFrame:
    """The steps a greedy search takes through recorded evaluations: each allowed row that beats all allowed rows before it."""
    w = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(allowed, F.col(score))).over(w)
    steps = evaluations.withColumn("best_before", best).where(allowed & (F.col("best_before").isNull() | (F.col(score) > F.col("best_before"))))
    return steps.withColumn("step", F.row_number().over(Window.partitionBy(unit).orderBy(*order)))


def order_moves(stages: DataFrame, item: str, stage: str, position: str) -> DataFrame:
    """Items whose rank among the items that two successive stages share changes, with both ranks."""
    w = Window.partitionBy(item).orderBy(stage)
    rows = stages.withColumn("before", F.lag(position).over(w)).withColumn("from_stage", F.lag(stage).over(w)).where(F.col("from_stage") == F.col(stage) - 1)
    rows = rows.select(item, stage, F.struct(position, item).alias("_now"), F.struct("before", item).alias("_was"))
    ranked = bags.numbered(rows, stage, "_now").withColumnRenamed("ordinal", "rank")  # in ranges where a stage has many items
    ranked = bags.numbered(ranked, stage, "_was").withColumnRenamed("ordinal", "rank_before")
    return ranked.where("rank <> rank_before").select(item, stage, "rank_before", "rank")


def padding_between(rows: DataFrame, group: str, order: list[str], padding: Column) -> DataFrame:
    """Padding rows before each boundary: per group and number of other rows so far, how many."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("boundary", F.sum(F.when(padding, 0).otherwise(1)).over(w)).where(padding)
    return placed.groupBy(group, "boundary").agg(F.count(F.lit(1)).alias("n_padding"))


def near_misses(rows: DataFrame, key: str, twin: Column, least: float) -> DataFrame:
    """Inexact rows (key, score, exact, size) of at least a score and a known size, without those whose twin key is there too."""
    keys = rows.select(F.col(key).alias("_twin")).distinct()
    chosen = rows.where(~F.col("exact") & (F.col("score") >= least) & F.col("size").isNotNull())
    return chosen.withColumn("_twin", twin).join(keys, "_twin", "left_anti").drop("_twin")


def busiest(rows: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """A top-k report: the ``most`` keys with findings in most groups, then with most findings, then the smallest."""
    per = rows.groupBy(key).agg(F.count_distinct(group).alias("n_functions"), F.count(F.lit(1)).alias("n_findings"))
    return per.orderBy(F.desc("n_functions"), F.desc("n_findings"), key).limit(most)


def first_cause(rows: DataFrame, causes: dict[str, Column], otherwise: str, name: str = "cause") -> DataFrame:
    """Rows with the name of the first condition that holds."""
    return rows.withColumn(name, F.coalesce(*[F.when(c, F.lit(n)) for n, c in causes.items()], F.lit(otherwise)))
