"""Searches over recorded evaluations, for many units at once: every round is a few joins over the units still open.

What a round decides is written, so a lost executor costs a re-read; units that stop leave the frontier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.bags import numbered
from millrace.sources.scratch import written


def batch_search(start: DataFrame, moves: DataFrame, scores: DataFrame, budget: int, batch: int, perfect: float, ties: bool = False) -> tuple[DataFrame, DataFrame]:
    """Search from each unit's source through recorded rewrites, in batches, within a budget a unit.

    ``start`` is (unit, at, score), ``moves`` (unit, source, place, target): rewrites of a source in
    their order, ``scores`` (unit, target, score, valid): what was recorded of a target; a target that
    isn't valid, or not recorded, is tried in vain. A round takes the next ``batch`` targets of the
    current source that were not tried before, as far as the budget goes, and moves to the best valid
    one that scores higher (with ``ties``, or as high; of equal ones the first). A unit is done when it
    reaches ``perfect``, spends its budget, or has nothing left to try.

    Returns (unit, at, score, best, best_at, tried, n_moves, reason) and the moves (unit, step, source,
    target, score).
    """
    state = start.select("unit", "at", "score", F.col("score").alias("best"), F.col("at").alias("best_at"), F.lit(0).alias("tried"), F.lit(0).alias("n_moves"))
    state = written(state.withColumn("reason", F.when(F.col("score") >= perfect, "exact")), "search")
    seen = written(start.select("unit", F.col("at").alias("target")), "seen")
    steps = None
    scores = scores.select("unit", "target", F.when(F.col("valid"), F.col("score")).alias("found"))
    while not (open_ := state.where("reason is null")).isEmpty():
        fresh = moves.join(open_.select("unit", F.col("at").alias("source"), "tried"), ["unit", "source"]).join(seen, ["unit", "target"], "left_anti")
        fresh = fresh.groupBy("unit", "target", "tried").agg(F.min("place").alias("place"))
        # the cut: a unit's candidates are numbered, in ranges where it has many, and end with its batch or budget
        chunk = numbered(fresh.withColumn("order", F.struct("place", "target")), "unit", "order")
        chunk = written(chunk.where(F.col("ordinal") <= F.least(F.lit(batch), budget - F.col("tried"))).select("unit", "target", "ordinal"), "batch")
        rated = chunk.join(scores, ["unit", "target"], "left").join(open_.select("unit", "score"), "unit")
        good = (F.col("found") >= F.col("score")) if ties else (F.col("found") > F.col("score"))
        best = F.max(F.when(good, F.struct("found", (-F.col("ordinal")).alias("first"), "target"))).alias("to")
        taken = rated.groupBy("unit").agg(F.count(F.lit(1)).cast("int").alias("n"), best)
        after = state.join(taken, "unit", "left")
        to = F.col("to.found")
        moved, higher = to.isNotNull(), to > F.col("best")
        over = F.col("tried") + F.coalesce("n", F.lit(0))
        reached = F.when(higher, to).otherwise(F.col("best"))
        reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(reached >= perfect, "exact").when(over >= budget, "budget spent").when(F.col("n").isNull(), "nothing left")
        after = after.select(
            "unit",
            F.col("at").alias("source"),
            F.when(moved, F.col("to.target")).otherwise(F.col("at")).alias("at"),
            F.when(moved, to).otherwise(F.col("score")).alias("score"),
            reached.alias("best"),
            F.when(higher, F.col("to.target")).otherwise(F.col("best_at")).alias("best_at"),
            over.alias("tried"),
            (F.col("n_moves") + moved.cast("int")).alias("n_moves"),
            reason.alias("reason"),
            F.coalesce(moved, F.lit(False)).alias("moved"),
        )
        after = written(after, "search")
        step = after.where("moved").select("unit", F.col("n_moves").alias("step"), "source", F.col("at").alias("target"), "score")
        steps = step if steps is None else steps.union(step)
        seen = seen.union(chunk.select("unit", "target"))
        state = after.drop("source", "moved")
    if steps is None:
        steps = state.select("unit", F.col("n_moves").alias("step"), F.col("at").alias("source"), F.col("at").alias("target"), "score").limit(0)
    return state, steps


def _digests(blocks: DataFrame) -> DataFrame:
    """(unit, place, block, n, whole, here, left, right): sums of hashes up to each place, of blocks where they are and one place to the left or right.

    An order's digest is the sum over its blocks of a hash of block and place, so a move changes it by a
    difference of these sums, and no order is copied.
    """
    up = Window.partitionBy("unit").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda shift, w: F.sum(hashed(F.col("block"), F.col("place") + shift)).over(w)
    every = Window.partitionBy("unit")
    return blocks.select("unit", "place", "block", F.count(F.lit(1)).over(every).cast("int").alias("n"), total(0, every).alias("whole"), total(0, up).alias("here"), total(-1, up).alias("left"), total(1, up).alias("right"))


def hashed(block: Column, place: Column) -> Column:
    return F.xxhash64(block.cast("string"), place.cast("int")).cast("decimal(38,0)")


def block_moves(blocks: DataFrame) -> DataFrame:
    """(unit, i, j, block, digest): every move of one block of (unit, block, place) from place i to j, with the digest of the order that it gives."""
    sums = _digests(blocks)
    to = sums.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("j <> place")
    # sums at j, and at the places before i and j
    low, high = F.least("place", "j"), F.greatest("place", "j")
    at = sums.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("here", "left", "right").alias("s")))).alias("sums"))  # one row a block
    rows = to.select("unit", F.col("place").alias("i"), "j", "block", "whole", low.alias("low"), high.alias("high")).join(at, "unit")
    none = F.lit(0).cast("decimal(38,0)")
    between = lambda name, a, b: F.element_at("sums", b)[name] - F.coalesce(F.try_element_at("sums", a)[name], none)
    before = between("here", F.col("low") - 1, F.col("high"))
    moved = F.when(F.col("i") < F.col("j"), between("left", F.col("i"), F.col("j"))).otherwise(between("right", F.col("j") - 1, F.col("i") - 1))
    return rows.select("unit", "i", "j", "block", (F.col("whole") - before + moved + hashed(F.col("block"), F.col("j"))).cast("string").alias("digest"))


def moved(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """(unit, block, place) after one move (unit, i, j) a unit; units without one stay."""
    rows = blocks.join(moves.select("unit", "i", "j"), "unit", "left")
    i, j, p = F.col("i"), F.col("j"), F.col("place")
    place = F.when(p == i, j).when((p > i) & (p <= j), p - 1).when((p < i) & (p >= j), p + 1).otherwise(p)
    return rows.select("unit", "block", place.cast("int").alias("place"))


def climb(blocks: DataFrame, evaluate: Callable[[DataFrame, DataFrame], DataFrame], budget: int, per_round: int, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Climb over moves of one block: (unit, block, place) of the best orders, and the moves (unit, step, i, j, block, total).

    ``evaluate(moves, blocks)`` tells (unit, i, j, dependent, exact) for the moves of the current orders;
    a move of (i, j) null is the current order itself. A round tries up to ``per_round`` moves that give an
    order not seen before (in ``order``, by default of a hash) within ``budget`` moves a unit. A move that
    loses a dependent that is exact, or that tells nothing of it, is not taken; of the others the
    one with most exact ones, if these are more than before (ties: the first).
    """
    order = F.xxhash64("unit", "digest") if order is None else order
    blocks = written(blocks.select("unit", "block", F.col("place").cast("int").alias("place")), "order")
    still = blocks.select("unit").distinct().select("unit", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"))
    best = written(evaluate(still, blocks).select("unit", "dependent", "exact"), "best")
    now = blocks.groupBy("unit").agg(F.sum(hashed(F.col("block"), F.col("place"))).cast("string").alias("digest"))
    seen = written(now, "seen")
    state = written(best.groupBy("unit").agg(F.count_if("exact").alias("total")).join(blocks.select("unit").distinct(), "unit", "right").select("unit", F.coalesce("total", F.lit(0)).alias("total"), F.lit(0).alias("tried"), F.lit(0).alias("step"), F.lit(True).alias("open")), "climb")
    steps = None
    while not (open_ := state.where("open")).isEmpty():
        live = blocks.join(open_.select("unit"), "unit")
        fresh = block_moves(live).join(seen, ["unit", "digest"], "left_anti").join(open_.select("unit", "tried"), "unit")
        first = Window.partitionBy("unit", "digest").orderBy(order, "i", "j")  # two moves can give one order
        fresh = fresh.withColumn("same", F.row_number().over(first)).where("same = 1")
        w = Window.partitionBy("unit").orderBy(order, "i", "j")
        tries = fresh.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= F.least(F.lit(per_round), budget - F.col("tried")))
        tries = written(tries.select("unit", "i", "j", "block", "digest", "ordinal"), "tries")
        told = written(evaluate(tries.select("unit", "i", "j"), live).select("unit", "i", "j", "dependent", "exact"), "told")
        mine = best.join(open_.select("unit"), "unit").where("exact").select("unit", "dependent")
        kept = told.where("exact").join(mine, ["unit", "dependent"]).groupBy("unit", "i", "j").agg(F.count(F.lit(1)).alias("kept"))
        totals = told.groupBy("unit", "i", "j").agg(F.count_if("exact").alias("now"))
        rated = tries.join(totals, ["unit", "i", "j"]).join(kept, ["unit", "i", "j"], "left").join(open_.select("unit", "total"), "unit")
        whole = (F.coalesce("kept", F.lit(0)) == F.col("total")) & (F.col("now") > F.col("total"))
        choice = F.max(F.when(whole, F.struct("now", (-F.col("ordinal")).alias("first"), "i", "j", "block"))).alias("to")
        taken = written(tries.groupBy("unit").agg(F.count(F.lit(1)).cast("int").alias("n")).join(rated.groupBy("unit").agg(choice), "unit", "left"), "taken")
        go = taken.where("to is not null").select("unit", "to.i", "to.j", "to.block", F.col("to.now").alias("now"))
        after = state.join(taken, "unit", "left")
        over = F.col("tried") + F.coalesce("n", F.lit(0))
        went = F.col("to").isNotNull()
        after = after.select("unit", F.when(went, F.col("to.now")).otherwise(F.col("total")).alias("total"), over.alias("tried"), (F.col("step") + went.cast("int")).alias("step"), (F.col("open") & F.col("n").isNotNull() & (over < budget)).alias("open"))
        after = written(after, "climb")
        step = written(after.join(go, "unit").select("unit", "step", "i", "j", "block", F.col("now").alias("total")), "step")
        steps = step if steps is None else steps.union(step)
        new = told.join(go.select("unit", "i", "j"), ["unit", "i", "j"]).select("unit", "dependent", "exact")
        best = written(best.join(go.select("unit"), "unit", "left_anti").union(new), "best")
        blocks = written(moved(blocks, go), "order")
        seen = seen.union(tries.select("unit", "digest"))
        state = after
    if steps is None:
        steps = blocks.select("unit", F.lit(0).alias("step"), F.col("place").alias("i"), F.col("place").alias("j"), "block", F.lit(0).cast("long").alias("total")).limit(0)
    return blocks, steps


#: Places that a task looks at together: of as many units of one size as have them.
PLACES = 1 << 16


def first_moves(n: int, most: int, order: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the first ``most`` moves of one of n blocks that give different orders, by ``order`` of i and j, then i, then j."""
    i, j, by = (np.zeros(0, np.int64) for _ in range(3))
    rows = max(1, (1 << 20) // n)
    for s in range(0, n, rows):
        x, y = (z.ravel() for z in np.meshgrid(np.arange(s, min(n, s + rows)), np.arange(n), indexing="ij"))
        x, y = x[x != y], y[x != y]
        i, j, by = np.append(i, x), np.append(j, y), np.append(by, order(x, y))
        first = np.lexsort((j, i, by))[: 2 * most]  # two moves give one order where they swap neighbours, and only there
        i, j, by = i[first], j[first], by[first]
    low = np.where(np.abs(i - j) == 1, np.minimum(i, j), -1 - np.arange(len(i)))
    keep = np.sort(np.unique(low, return_index=True)[1])[:most]
    return i[keep], j[keep]


def _placed(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where what is at place p comes to when i moves to j."""
    return np.where(p == i, j, p - ((p > i) & (p <= j)) + ((p < i) & (p >= j)))


def _mixed(block: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of blocks at places."""
    h = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place + 2).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(by))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class Climb:
    """Units of n blocks each that climb together; a block goes by its first place, a constraint is (unit, block before, block after)."""

    def __init__(self, units: int, n: int, of: np.ndarray, before: np.ndarray, after: np.ndarray, budget: int) -> None:
        self.unit = np.arange(units)
        self.place = np.tile(np.arange(n), (units, 1))  # of each block
        self.of, self.before, self.after = of, before, after
        self.tried, self.step = np.zeros(units, np.int64), np.zeros(units, np.int64)
        self.seen = np.zeros((units, budget + 1), np.uint64)
        self.at = self.place.copy()  # at each place
        self.seen[:] = self.sums(0)[:, -1:]

    def sums(self, shift: int) -> np.ndarray:
        """Sums of hashes of the blocks at the first places, 0 to n of them, each at its place moved by ``shift``."""
        h = _mixed(self.at, np.arange(self.at.shape[1]) + shift)
        return np.concatenate([np.zeros((len(h), 1), np.uint64), np.cumsum(h, axis=1, dtype=np.uint64)], axis=1)

    def held(self) -> np.ndarray:
        return self.place[self.of, self.before] < self.place[self.of, self.after]

    def digests(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the order that each unit (rows) has after each move (columns)."""
        self.at = np.argsort(self.place, axis=1)
        here, left, right = (self.sums(shift) for shift in (0, -1, 1))
        low, high = np.minimum(i, j), np.maximum(i, j)
        between = np.where(i < j, left[:, high + 1] - left[:, i + 1], right[:, i] - right[:, low])
        return here[:, -1:] - (here[:, high + 1] - here[:, low]) + between + _mixed(self.at[:, i], j)

    def round(self, i: np.ndarray, j: np.ndarray, budget: int, per_round: int) -> list[np.ndarray]:
        """Try and move once; (unit, step, i, j, block, total) of the units that moved. Units that are done leave."""
        digest = self.digests(i, j)
        fresh = np.ones(digest.shape, bool)
        for s in range(1 + int(self.tried.max())):
            fresh &= digest != self.seen[:, s : s + 1]
        ordinal = np.cumsum(fresh, axis=1)
        row, move = np.nonzero(fresh & (ordinal <= np.minimum(per_round, budget - self.tried)[:, None]))
        ordinal, x, y = ordinal[row, move], i[move], j[move]
        held, units = self.held(), len(self.unit)
        total = np.bincount(self.of[held], minlength=units)
        times = np.bincount(self.of, minlength=units)
        one = np.repeat(np.arange(len(row)), times[row])  # a row for each try and constraint of its unit
        c = (np.cumsum(times) - times)[row][one] + np.arange(len(one)) - (np.cumsum(times[row]) - times[row])[one]
        exact = _placed(self.place[row[one], self.before[c]], x[one], y[one]) < _placed(self.place[row[one], self.after[c]], x[one], y[one])
        now = np.bincount(one[exact], minlength=len(row))
        kept = np.bincount(one[exact & held[c]], minlength=len(row))
        good = np.flatnonzero((kept == total[row]) & (now > total[row]))
        good = good[np.lexsort((ordinal[good], -now[good], row[good]))]
        go, first = np.unique(row[good], return_index=True)
        best = good[first]
        self.seen[row, self.tried[row] + ordinal] = digest[row, move]
        n = np.bincount(row, minlength=units)
        self.tried += n
        self.step[go] += 1
        out = [self.unit[go], self.step[go], x[best], y[best], self.at[go, x[best]], now[best]]
        self.place[go] = _placed(self.place[go], x[best][:, None], y[best][:, None])
        self.leave((n > 0) & (self.tried < budget))
        return out

    def leave(self, stay: np.ndarray) -> None:
        kept = stay[self.of]
        self.of, self.before, self.after = (np.cumsum(stay) - 1)[self.of[kept]], self.before[kept], self.after[kept]
        self.unit, self.place, self.tried, self.step, self.seen = (v[stay] for v in (self.unit, self.place, self.tried, self.step, self.seen))


def climb_precedence(blocks: DataFrame, constraints: DataFrame, budget: int, per_round: int, order: Callable) -> DataFrame:
    """The moves (unit, step, i, j, block, total) of ``climb`` with ``precedence``, where what a move gives can be told from the unit alone.

    ``order`` gives the order of moves from arrays i and j. A unit is a row, with its blocks and its
    constraints; a task takes units of one size together through a round. All that a round may try is
    among the first moves that are as many as a unit can have seen and a round tries, so a unit of n
    blocks needs memory for n places and not for its moves.
    """
    found = constraints.groupBy("unit").agg(F.collect_list(F.struct("before", "after")).alias("pairs"))
    rows = blocks.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("block")))).alias("blocks"))
    rows = rows.where(F.size("blocks") > 1).join(found, "unit", "left").select("unit", F.col("blocks.block").alias("blocks"), F.col("pairs.before").alias("before"), F.col("pairs.after").alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes, times = (np.asarray(batch.column(c).value_lengths().fill_null(0), np.int64) for c in ("blocks", "before"))
            named = pa.concat_arrays([batch.column(c).flatten() for c in ("blocks", "before", "after")]).dictionary_encode()
            code = np.asarray(named.indices.fill_null(-1), np.int64)
            block, before, after = np.split(code, [sizes.sum(), sizes.sum() + times.sum()])
            begin = np.cumsum(sizes) - sizes
            # a constraint's blocks by their first places in its unit
            owner, whose = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), times)
            key = owner * (len(code) + 1) + block
            by = np.argsort(key)
            at = []
            for side in (before, after):
                want = whose * (len(code) + 1) + side
                k = by[np.minimum(np.searchsorted(key, want, sorter=by), len(key) - 1)]
                at.append(np.where((key[k] == want) & (side >= 0), k - begin[owner[k]], -1))
            known = (at[0] >= 0) & (at[1] >= 0)
            whose, before, after = whose[known], at[0][known], at[1][known]
            many = np.bincount(whose, minlength=len(sizes))
            start = np.cumsum(many) - many
            for n in np.unique(sizes).tolist():
                if n not in moves:
                    moves[n] = first_moves(n, budget + 1 + per_round, order)
                same = np.flatnonzero((sizes == n) & (many > 0))  # without constraints there is nothing to gain
                each = max(1, PLACES // n)
                for s in range(0, len(same), each):
                    some = same[s : s + each]
                    of = np.repeat(np.arange(len(some)), many[some])
                    c = start[some][of] + np.arange(len(of)) - (np.cumsum(many[some]) - many[some])[of]
                    climbing = Climb(len(some), n, of, before[c], after[c], budget)
                    while len(climbing.unit):
                        unit, step, i, j, first, total = climbing.round(*moves[n], budget, per_round)
                        if len(unit):
                            unit = some[unit]
                            names = named.dictionary.take(named.indices.take(pa.array(begin[unit] + first)))
                            columns = [batch.column("unit").take(pa.array(unit)), *[pa.array(v, pa.int32()) for v in (step, i, j)], names, pa.array(total, pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns, ["unit", "step", "i", "j", "block", "total"])

    numbers = [T.StructField(c, T.IntegerType()) for c in ("step", "i", "j")]
    schema = T.StructType([blocks.schema["unit"], *numbers, blocks.schema["block"], T.StructField("total", T.LongType())])
    return rows.mapInArrow(run, schema)


def recorded(evaluations: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """An ``evaluate`` for ``climb`` that looks orders up by digest in (unit, digest, dependent, exact)."""

    def evaluate(moves: DataFrame, blocks: DataFrame) -> DataFrame:
        now = blocks.groupBy("unit").agg(F.sum(hashed(F.col("block"), F.col("place"))).cast("string").alias("digest"))
        tried = moves.where("i is not null").join(block_moves(blocks).select("unit", "i", "j", "digest"), ["unit", "i", "j"])
        still = moves.where("i is null").join(now, "unit")
        return tried.unionByName(still).join(evaluations, ["unit", "digest"]).select("unit", "i", "j", "dependent", "exact")

    return evaluate


def until_clean(repairs: DataFrame, faults: DataFrame, most: bool = True) -> tuple[DataFrame, DataFrame]:
    """Add one thing after the other until nothing is broken: (unit, step, addition, repaired, left) and (unit, left, reason).

    ``faults`` is (unit, fault), ``repairs`` (unit, addition, fault). A step adds what repairs most of
    what is still broken (or, if not ``most``, the first addition by name that repairs anything); ties go to
    the smaller name. How much each addition still repairs is counted once; then every round only
    looks at the faults that it repaired, and lowers the counts of the other additions by theirs. Units are
    ``clean``, or ``stuck`` when nothing repairs the rest.
    """
    faults = written(faults.select("unit", "fault").distinct(), "faults")
    edges = written(repairs.select("unit", "addition", "fault").distinct().join(faults, ["unit", "fault"]), "edges")
    counts = written(edges.groupBy("unit", "addition").agg(F.count(F.lit(1)).alias("n")), "counts")
    left = written(faults.groupBy("unit").agg(F.count(F.lit(1)).alias("left")), "left")
    steps, round_ = None, 0
    while not counts.isEmpty():
        round_ += 1
        rank = -F.col("n") if most else F.lit(0)
        best = counts.groupBy("unit").agg(F.min(F.struct(rank.alias("rank"), "addition", "n")).alias("to"))
        chosen = written(best.select("unit", "to.addition", F.col("to.n").alias("repaired")), "chosen")
        gone = written(edges.join(chosen, ["unit", "addition"]).select("unit", "fault"), "gone")
        lower = edges.join(gone, ["unit", "fault"]).groupBy("unit", "addition").agg(F.count(F.lit(1)).alias("less"))
        counts = written(counts.join(lower, ["unit", "addition"], "left").select("unit", "addition", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).where("n > 0"), "counts")
        edges = written(edges.join(gone, ["unit", "fault"], "left_anti"), "edges")
        left = written(left.join(chosen, "unit", "left").select("unit", (F.col("left") - F.coalesce("repaired", F.lit(0))).alias("left")), "left")
        step = chosen.join(left, "unit").select("unit", F.lit(round_).alias("step"), "addition", "repaired", "left")
        steps = step if steps is None else steps.union(step)
    if steps is None:
        steps = edges.select("unit", F.lit(0).alias("step"), "addition", F.lit(0).cast("long").alias("repaired"), F.lit(0).cast("long").alias("left")).limit(0)
    return steps, left.withColumn("reason", F.when(F.col("left") == 0, "clean").otherwise("stuck"))


def precedence(constraints: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """An ``evaluate`` for ``climb``: a dependent (unit, dependent, before, after) is exact where one block comes before the other."""

    def evaluate(moves: DataFrame, blocks: DataFrame) -> DataFrame:
        of = lambda name: blocks.select("unit", F.col("block").alias(name), F.col("place").alias(f"p_{name}"))
        rows = moves.join(constraints.join(of("before"), ["unit", "before"]).join(of("after"), ["unit", "after"]), "unit")
        i, j = F.col("i"), F.col("j")

        def placed(p: Column) -> Column:
            return F.when(p == i, j).when((p > i) & (p <= j), p - 1).when((p < i) & (p >= j), p + 1).otherwise(p)

        return rows.select("unit", "i", "j", "dependent", (placed(F.col("p_before")) < placed(F.col("p_after"))).alias("exact"))

    return evaluate
