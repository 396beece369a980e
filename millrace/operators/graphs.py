"""Closures and fixpoints over edge tables, as frontier loops.

Lineage is cut by a table in the folder of ``spark.checkpoint.dir`` each round, so a lost executor
costs a re-read, not a replay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import written as _written


#: Steps along edges between two writes, and writes between two of all reached nodes together.
HOPS, COMPACT = 4, 8


def closure(edges: DataFrame, start: DataFrame, hops: int = HOPS) -> DataFrame:
    """(node, depth): everything that (source, target) edges reach from (node) rows, at its least depth.

    Every round goes ``hops`` steps on from the frontier and keeps what is new. A node's last step but
    one is reached earlier or in the same round, so the least depth of the round is the least of all.
    """
    edges = _written(edges.select("source", "target").distinct())
    reached = frontier = _written(start.select("node", F.lit(0).alias("depth")).distinct())
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        step, seen = frontier, None
        for _ in range(hops):
            step = step.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"))
            step = step.groupBy("node").agg(F.min("depth").alias("depth"))
            seen = step if seen is None else seen.union(step)
        new = seen.groupBy("node").agg(F.min("depth").alias("depth")).join(reached.select("node"), "node", "left_anti")
        frontier = _written(new)
        reached = reached.union(frontier)
        if rounds % COMPACT == 0:
            reached = _written(reached)
    return reached


def users(edges: DataFrame, roots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root): those of many roots whose closure holds one of the ``wanted`` nodes: one closure of these, backwards."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return roots.select("root").distinct().join(closure(back, wanted).select(F.col("node").alias("root")), "root")


def chained(records: DataFrame, heads: DataFrame, address: str, following: str, valid: str) -> DataFrame:
    """(at, state, ...): the records that chains from ``heads`` (at) lead to: ``live``, ``stale`` (not valid: the chain ends) or ``unread`` (not among the records)."""
    edges = records.where(F.col(valid) & (F.col(following) != 0)).select(F.col(address).alias("source"), F.col(following).alias("target"))
    found = closure(edges, heads.select(F.col("at").alias("node"))).select(F.col("node").alias("at"))
    rows = found.join(records.withColumnRenamed(address, "at"), "at", "left")
    return rows.withColumn("state", F.when(F.col(valid).isNull(), "unread").when(F.col(valid), "live").otherwise("stale"))


def learned(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(node, value): what is known and claimed together; reading it fails if a node has two values."""
    both = known.select("node", "value").union(claims.select("node", "value"))
    one = both.groupBy("node").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    ok = F.when(F.col("value").eqNullSafe(F.col("other")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two claims for "), F.col("node").cast("string"))).cast("boolean"))
    return one.where(ok).select("node", "value")


def learn(step: Callable[[DataFrame, DataFrame], DataFrame], start: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, value): what follows from the start by ``step``, round by round, until nothing is new.

    ``step(new, known)`` claims values from what the last round added, joined to all that is known, so a
    round costs what it adds. Two claims for one node, or a claim against what is known, fail, and
    so does a claim that says again what is known: a step is to claim what it doesn't know.
    """
    known = new = _written(learned(start, start.limit(0)))
    for round_ in range(rounds):
        claims = _written(step(new, known).select("node", "value").distinct())
        if claims.isEmpty():
            return known
        again = claims.join(known.withColumnRenamed("value", "before"), "node")
        fault = F.when(F.col("value").eqNullSafe(F.col("before")), "claimed again: ").otherwise("two claims for ")
        again.select(F.raise_error(F.concat(fault, F.col("node").cast("string"))).cast("string").alias("e")).collect()
        new = _written(learned(claims, claims.limit(0)))
        known = known.union(new)
        if round_ % COMPACT == COMPACT - 1:
            known = _written(known)
    raise RuntimeError("claims did not settle")


def cycles(claims: DataFrame) -> DataFrame:
    """(name, other, cycle, length, place): a renaming of names onto themselves as cycles; reading it fails if it is none.

    ``claims`` (name, other) must name every one of its names once on either side. A cycle is named by its
    smallest name; places count from it. Rounds double the steps, so a cycle of n names takes log n.
    """
    one = claims.select("name", "other").distinct()
    sides = one.select("name", F.lit(1).alias("from"), F.lit(0).alias("to")).union(one.select("other", F.lit(0), F.lit(1)))
    ends = _written(sides.groupBy("name").agg(F.sum("from").alias("from"), F.sum("to").alias("to")))
    fault = F.concat(F.lit("not a renaming at "), F.col("name").cast("string"))
    ends.where(F.col("name").isNull() | (F.col("from") != 1) | (F.col("to") != 1)).select(F.raise_error(F.coalesce(fault, F.lit("not a renaming at null"))).cast("string").alias("e")).collect()
    one = _written(one)
    state = _written(one.select("name", F.col("other").alias("at"), F.least("name", "other").alias("low")))
    while True:
        on = state.select(F.col("name").alias("at"), F.col("at").alias("further"), F.col("low").alias("lower"))
        state = _written(state.join(on, "at").select("name", F.col("further").alias("at"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("fell")))
        fell = not state.where("fell").isEmpty()
        state = state.select("name", "at", "low")
        if not fell:
            break
    sizes = state.groupBy("low").agg(F.count(F.lit(1)).alias("length"))
    named = _written(one.join(state.select("name", "low"), "name").join(sizes, "low"))
    to_first, _ = followed(named.where("other <> low").select("name", "other").select(F.col("name").alias("node"), F.col("other").alias("to")))
    # the last of a cycle leads to its first: how far a name is from there
    ahead = named.join(to_first.select(F.col("node").alias("name"), F.col("length").alias("ahead")), "name", "left")
    return ahead.select("name", "other", F.col("low").alias("cycle"), "length", (F.col("length") - 1 - F.coalesce("ahead", F.lit(0))).alias("place"))


def renamed(table: DataFrame, name: str, values: list[str], claims: DataFrame) -> DataFrame:
    """The rows of ``table`` (one a name), those of the renaming with the values of what they are renamed to, all at once.

    Fails if the claims are no renaming of names onto themselves, or name what isn't in the table.
    """
    ring = cycles(claims).select("name", "other")
    held = table.select(F.col(name).alias("other"), F.struct(*values).alias("_new"))
    to = _written(ring.join(held, "other", "left").select(F.col("name").alias(name), "_new"))
    to.where("_new is null").select(F.raise_error(F.concat(F.lit("unknown name for "), F.col(name).cast("string"))).cast("string").alias("e")).collect()
    rows = table.join(to, name, "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node that undirected (source, target) edges connect a node with.

    Each round takes the smallest label among neighbours and then that label's own label, so long
    paths shrink by halves.
    """
    both = _written(edges.select("source", "target").union(edges.select("target", "source")).where("source <> target").distinct())
    labels = _written(nodes.select("node").distinct().select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "target"), "target").groupBy("source").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("source"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = _written(low.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("new"), F.col("label").alias("old")))
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("new <> old").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def followed(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where (node, to) rows, one a node, lead: (node, end, length) of the nodes that reach one without a row, and (node) of the others.

    Every round doubles the steps, so there are as many rounds as the longest way has binary digits. A
    way that is longer than there are nodes has no end.
    """
    state = _written(steps.select("node", F.col("to").alias("at"), F.lit(1).cast("long").alias("length")))
    left = 2 * state.count()  # one round more, in which what has ended does not move
    while left > 0:
        on = state.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("length").alias("more"))
        state = _written(state.join(on, "at", "left").select("node", F.coalesce("further", "at").alias("at"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.col("further").isNotNull().alias("open")))
        if state.where("open").isEmpty():
            break
        left //= 2
        state = state.select("node", "at", "length") if left else state
    if "open" not in state.columns:
        state = state.withColumn("open", F.lit(False))
    return state.where("not open").select("node", F.col("at").alias("end"), "length"), state.where("open").select("node", F.col("at"))


def single_chains(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Follow each start node while it has exactly one target: (node, end, length, why): ``end``, ``ambiguous`` or ``cycle``.

    A chain that comes round ends before the first node that it has passed.
    """
    out = _written(edges.select("source", "target").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")))
    single = out.where("n = 1").select(F.col("source").alias("node"), F.col("target").alias("to"))
    ended, open_ = followed(single)
    # all nodes of cycles are led to, and nothing else is, after as many steps as there are nodes
    ring = _written(open_.select(F.col("at").alias("node")).distinct())
    round_ = single.join(ring, "node")
    sizes = components(round_.select(F.col("node").alias("source"), F.col("to").alias("target")), ring)
    sizes = _written(sizes.join(sizes.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label").select("node", "size"))
    last = round_.select(F.col("to").alias("entry"), F.col("node").alias("end"))  # the node of the ring before an entry
    tails, _ = followed(single.join(open_.select("node"), "node").join(ring, "node", "left_anti"))
    entries = tails.select("node", F.col("end").alias("entry"), "length").union(ring.select("node", F.col("node").alias("entry"), F.lit(0).cast("long")))
    rings = entries.join(sizes.withColumnRenamed("node", "entry"), "entry").join(last, "entry").select("node", "end", (F.col("length") + F.col("size") - 1).alias("length"), F.lit("cycle").alias("why"))
    several = out.where("n > 1").select(F.col("source").alias("end"), F.lit("ambiguous").alias("why"))
    begun = start.select("node").distinct()
    straight = begun.join(single, "node", "left_anti").select("node", F.col("node").alias("end"), F.lit(0).cast("long").alias("length")).union(begun.join(ended, "node"))
    straight = straight.join(several, "end", "left").select("node", "end", "length", F.coalesce("why", F.lit("end")).alias("why"))
    found = straight.union(begun.join(rings, "node").select("node", "end", "length", "why"))
    return found.withColumn("length", F.col("length").cast("int"))
