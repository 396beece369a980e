"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

A document's set holds the distinct hashes of its 5-word shingles. Documents with equal sets form
a class; only classes are joined, each by a number of its own. Sets of at most ``x`` shingles are light, the others heavy, and
``boundary`` picks x from the histogram of sizes as the cheapest.

* Light with light: for each partner size b a set of a shingles lists its subsets of the overlap
  that a link needs, ceil(3 (a + b) / 7). Two sets that share such a subset are linked; as subsets
  are compared by hashes, the two texts are compared all the same.
* Heavy with heavy or light: inverted lists. Shingles are ordered, frequent ones last, and each
  set is put on the lists of its first a - ceil(3 a / 4) + 1 shingles; linked sets share a list.

Lists of a large group of near copies have all of its members, so pairs of a list are not listed
outright. First every member of a list is tested against a few pivots of the list and links are
closed to components. Then only pairs of a list whose components still differ are left. Exact bounds
on how many lists two sets of given sizes must share, and on the place of the first of them, leave a
set few sizes that its partners may have; it meets only those, by an equi-join on list and size
bucket, before texts are compared. No link is lost: a pair that is never tested lies within one
component already, or a bound rules it out.

Links are counted once components are known: within each, all pairs whose sizes allow a link are
compared, block by block. That is quadratic in the classes of a component, as its links are.

What is known of a list (its pivots, how many members it has) is an aggregate that each task folds
before the shuffle, written and joined back, so that no list lies in one task. Lists are gathered in
``PARTS`` turns, each of the keys of one remainder, and tables go as soon as nothing reads them again,
so that the disk never holds the shuffles of all entries, nor entries beside what comes later.

Frequent shingles are those that repeat within a task's texts; the order needs no exact counts to
be right, only to be the same everywhere, so a fixed number of them (``FREQUENT``) is broadcast.

Defined cases: null, empty and blank texts have the empty set and no links; repeated rows and equal
sets are one class; rows that share an id are rows of their own, linked only by their texts; a row
without an id can link others and has their component's smallest id; texts are read whole; an empty
table gives an empty one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.components import components

WORDS = 5
#: Shingles that are ordered by frequency; all others count as rare.
FREQUENT = 1 << 18
#: A pair is counted on those lists only whose pivot it has, so the first round lets it through with a third of the lists.
SLACK = 3
#: Largest light size that is considered, and what testing one candidate costs in list entries.
LIGHT_MOST, TEST_COST = 12, 64
#: Shingles that a task looks at together for frequent ones.
HELD = 2_000_000
#: A list of up to this many rows' names is broadcast to pick out the texts to compare.
BROADCAST_IDS = 1_000_000
#: Texts that one copy of another text is tested against.
HUB_MEMBERS = 100
#: Turns in which lists are gathered from the entries; each has all entries of its keys.
PARTS = 3
#: Ratio of the sizes in one bucket.
BUCKET = 1.03
#: Sets, and shingles of them, that a task holds to count links with others.
BLOCK_SETS, BLOCK_SHINGLES = 64, 1 << 20
#: Ratio of the sizes in one band of a component; linked sets are in one band or in neighbours, as it is above 4 / 3.
BAND = 1.34
#: Matches of shingles that are counted at a time.
MATCHES = 1 << 20


def need(a, b):
    """Smallest overlap of linked sets of a and b shingles: 100 * overlap >= 75 * union."""
    return -(-3 * (a + b) // 7)


def prefix(a):
    return a - -(-3 * a // 4) + 1


def partners(a: int, most: int) -> range:
    return range(-(-3 * a // 4), min(most, 4 * a // 3) + 1)


def subsets(a: int, most: int) -> int:
    """Entries that a light set of a shingles makes."""
    return sum(math.comb(a, need(a, b)) for b in partners(a, most))


def boundary(sizes: dict[int, int]) -> int:
    """The x of least cost for this histogram: subsets of the light sets, prefixes and tests of the others."""

    def cost(x: int) -> int:
        light = sum(n * subsets(a, x) for a, n in sizes.items() if a <= x)
        return light + sum(n * (prefix(a) + TEST_COST) for a, n in sizes.items() if 4 * a // 3 > x)

    return min(range(1, LIGHT_MOST + 1), key=cost)


class Sets:
    """Shingle sets of a run of rows, laid end to end and sorted within each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> None:
        data = C.LOWER[data]
        s, e, first = C.word_spans(data, offsets, C.SPACED)
        h = C.span_hashes(data, s, e)
        n_words = np.diff(first)
        n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
        row, place = C.runs_of(n)
        start = first[:-1][row] + place
        shingle = C.sequence_hashes(h, start, np.minimum(n_words[row], words)) >> np.uint64(1)
        order = np.lexsort((shingle, row))
        shingle, row = shingle[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
        self.row, self.shingle = row[new], shingle[new]
        self.size = np.bincount(self.row, minlength=len(n))
        self.begin = np.cumsum(self.size) - self.size

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that are equal for equal sets."""
        out = []
        for salt in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(self.shingle ^ np.uint64(salt)))])
            out.append(C.mix(sums[self.begin + self.size] - sums[self.begin]).view(np.int64))
        return out[0], out[1]


def _sets(column, words: int) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = C.bytes_of(column)
    for i, j in C.steps(offsets):
        yield i, j, Sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, did, rid, n, s1, s2) of each row, and rows (null, null, null, times, shingle, null) for shingles that repeat in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ["doc_id", *C.KEY]
        names = [*own, "n", "s1", "s2"]
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            found, times = found[times > 1], times[times > 1]
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(times), pa.array(found.view(np.int64)), none], names)

        for batch in batches:
            for i, j, sets in _sets(batch.column("text"), words):
                s1, s2 = sets.signatures()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in own), pa.array(sets.size), pa.array(s1), pa.array(s2)], names)
                for k, (sig, n, at) in enumerate(zip(s1.tolist(), sets.size.tolist(), sets.begin.tolist())):
                    if n and sig not in seen:  # copies count once
                        seen.add(sig)
                        held.append(sets.shingle[at : at + n])
                        size += n
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield flush()

    return C.map_arrow(C.keyed(docs), run, "doc_id long, did long, rid long, n long, s1 long, s2 long")


def entries(docs: DataFrame, frequent: np.ndarray, x: int, words: int = WORDS) -> DataFrame:
    """(kind, key, s1, n): kind 0 is a list of a prefix shingle, kind a * 1000 + b a subset for sizes a <= b.

    ``frequent`` has the frequent shingles, the most frequent last.
    """
    order = np.argsort(frequent)
    known = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = known.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in _sets(batch.column("text"), words):
                s1, _ = sets.signatures()
                fresh = np.zeros(len(s1), bool)
                for k, (sig, n) in enumerate(zip(s1.tolist(), sets.size.tolist())):
                    if n > 1 and sig not in seen:
                        seen.add(sig)
                        fresh[k] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                size = sets.size
                listed = fresh & (4 * size // 3 > x)
                at = np.flatnonzero(listed[sets.row])
                shingle, row = sets.shingle[at], sets.row[at]
                key = shingle
                if len(common):
                    k = np.searchsorted(common, shingle)
                    k[k == len(common)] = 0
                    key = np.where(common[k] == shingle, rank[k] | np.uint64(1 << 63), shingle)
                order = np.lexsort((key, row))
                row, shingle = row[order], shingle[order]
                begin = np.searchsorted(row, row)
                keep = np.arange(len(row)) - begin < prefix(size[row])
                row, shingle = row[keep], shingle[keep]
                kinds, keys, rows = [np.zeros(len(row), np.int32)], [shingle], [row]
                for r in np.flatnonzero(fresh & (size <= x)).tolist():
                    a = int(size[r])
                    own = sets.shingle[sets.begin[r] : sets.begin[r] + a]
                    for b in partners(a, x):
                        pick = np.array(list(combinations(range(a), need(a, b))), np.int64)
                        with np.errstate(over="ignore"):
                            keys.append(C.mix(C.mix(own)[pick].sum(axis=1, dtype=np.uint64)) >> np.uint64(1))
                        kinds.append(np.full(len(pick), min(a, b) * 1000 + max(a, b), np.int32))
                        rows.append(np.full(len(pick), r))
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(s1[row]), pa.array(size[row].astype(np.int32))],
                    ["kind", "key", "s1", "n"],
                )

    return C.map_arrow(C.id_and_text(docs), run, "kind int, key long, s1 long, n int")


def overlaps(dealt: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, common, na, nb) of rows (hub, piece, member, text): each member's set against its hub's.

    Rows are sorted by hub and piece, and a row without a member is the hub's own, which comes first. A
    task holds one hub's set and a step of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, members = (np.array(batch.column(c).to_pylist(), object) for c in ("hub", "member"))
            for i, j, sets in _sets(batch.column("text"), words):
                first = np.array([m is None for m in members[i:j]], bool)
                starts = np.flatnonzero(first | (np.arange(j - i) == 0)).tolist()
                out: list[tuple[int, int, int, int, int]] = []
                for s, e in zip(starts, [*starts[1:], j - i]):
                    if first[s]:
                        hub = hubs[i + s]
                        own = sets.shingle[sets.begin[s] : sets.begin[s] + sets.size[s]].copy()
                        s += 1
                    if s == e:
                        continue
                    low, high = sets.begin[s], sets.begin[e - 1] + sets.size[e - 1]
                    theirs, row = sets.shingle[low:high], sets.row[low:high] - s
                    held = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs if len(own) else np.zeros(len(theirs), bool)
                    common = np.bincount(row[held], minlength=e - s)
                    for m, c, n in zip(members[i + s : i + e].tolist(), common.tolist(), sets.size[s:e].tolist()):
                        out.append((hub, m, c, len(own), n) if hub < m else (m, hub, c, n, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], ["a", "b", "common", "na", "nb"])

    return C.map_arrow(dealt.select("hub", "member", "text"), run, "a long, b long, common long, na long, nb long")


class Block:
    """Sets that others are counted against: their names, sizes, and all their shingles in order with the set of each."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def hold(self, cid: np.ndarray, size: np.ndarray, shingle: np.ndarray, row: np.ndarray) -> None:
        held = sum(len(p[0]) for p in self.parts)
        self.parts.append((cid.copy(), size.copy(), shingle.copy(), row + held))

    def close(self) -> None:
        self.cid, self.size, self.shingle, self.row = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, order = [], np.argsort(self.shingle, kind="stable")
        self.key, self.of = self.shingle[order], self.row[order]
        self.links = np.zeros(len(self.cid), np.int64)

    def linked(self, size: np.ndarray, shingle: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which of the block's sets (rows) are linked with which of these (columns)."""
        common = np.zeros(len(self.cid) * len(size), np.int64)
        low = np.searchsorted(self.key, shingle)
        times = np.searchsorted(self.key, shingle, "right") - low
        upto = np.cumsum(times)
        i = 0
        while i < len(shingle):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + MATCHES, "right")))
            of, place = C.runs_of(times[i:j])
            common += np.bincount(self.of[low[i:j][of] + place] * len(size) + row[i:j][of], minlength=len(common))
            i = j
        common = common.reshape(len(self.cid), len(size))
        return (7 * common >= 3 * (self.size[:, None] + size[None, :])) & (common > 0)

    def meet(self, size: np.ndarray, shingle: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many sets of the block each of these is linked with; counted for both."""
        linked = self.linked(size, shingle, row)
        self.links += linked.sum(axis=1)
        return linked.sum(axis=0)

    def meet_itself(self) -> None:
        linked = self.linked(self.size, self.shingle, self.row)
        np.fill_diagonal(linked, False)
        self.links += linked.sum(axis=1)


#: What a set is in a pair of blocks: held, met by the held ones, or held in a block that meets itself.
HELD_SIDE, MET_SIDE, OWN_SIDE = 0, 1, 2


def link_counts(sent: DataFrame, words: int = WORDS) -> DataFrame:
    """(cid, links) of rows (pair, side, cid, text): links across each pair of blocks, several rows a set.

    Rows are sorted by pair and side. A task holds the sets of one block and a step of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, own = None, Block(), False
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def end() -> None:
            if block.parts:
                block.close()
            if pair is not None:
                if own:
                    block.meet_itself()
                found.append((block.cid, block.links))

        def counts() -> pa.RecordBatch:
            cids, links = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ([], [])))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(cids), pa.array(links)], ["cid", "links"])

        for batch in batches:
            pairs, sides, cids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "side", "cid"))
            for i, j, sets in _sets(batch.column("text"), words):
                new = np.ones(j - i, bool)
                new[1:] = (pairs[i + 1 : j] != pairs[i : j - 1]) | (sides[i + 1 : j] != sides[i : j - 1])
                starts = np.flatnonzero(new).tolist()
                for s, e in zip(starts, [*starts[1:], j - i]):
                    if pairs[i + s] != pair:
                        end()
                        pair, block, own = pairs[i + s], Block(), sides[i + s] == OWN_SIDE
                    low, high = sets.begin[s], sets.begin[e - 1] + sets.size[e - 1]
                    part = sets.size[s:e], sets.shingle[low:high], sets.row[low:high] - s
                    if sides[i + s] == MET_SIDE:
                        if block.parts:
                            block.close()
                        found.append((cids[i + s : i + e], block.meet(*part)))
                    else:
                        block.hold(cids[i + s : i + e], *part)
            if found:
                yield counts()
        end()
        if found:
            yield counts()

    return C.map_arrow(sent.select("pair", "side", "cid", "text"), run, "cid long, links long")


#: The overlap that a link needs, less the larger rest.
_LISTS_NEEDED = "((3 * ({a} + {b}) + 6) div 7 - (3 * greatest({a}, {b}) + 3) div 4 + 1)"


def _may_link(a: str, b: str, lists: str) -> str:
    """Condition for sets of a and b shingles on ``lists`` common lists.

    Of two sets on a list, let the first's prefix end earlier in the order: what they share up to
    there is on common lists, and beyond it the first has its rest, so the overlap is at most the
    common lists and the larger rest.
    """
    return f"4 * least({a}, {b}) >= 3 * greatest({a}, {b}) and {lists} >= {_LISTS_NEEDED.format(a=a, b=b)}"


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BUCKET)).cast("int")


def _lists(members: DataFrame) -> DataFrame:
    """(s1, n, pivot, pivot_n, lists): pairs of sets to test first, and on how many lists one is for the other.

    ``members`` are the entries of lists of two sets or more. The pivots of each list and band of
    sizes are the members on most lists, which edits have changed least; the smallest of a list is
    tested against the other bands' first pivots.
    """
    # two sets share at most as many lists as either is on with others
    lists = members.join(members.groupBy("s1").agg(F.count(F.lit(1)).alias("m")), "s1")
    lists = C.materialise(lists.withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")), "lists")
    # m before all else, then some order of s1; numbers alone, so that tasks fold them by hash and not by sorting
    most, high, sized = F.shiftleft(F.col("m"), 32), F.shiftrightunsigned("s1", 32), F.shiftleft(F.col("m"), 32) + F.col("n")
    orders = {"first": most - high, "last": most + high, "other": most + F.hash("s1").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))}
    picks = [F.max_by(v, by).alias(f"{name}_{c}") for name, by in orders.items() for c, v in (("s1", F.col("s1")), ("sized", sized))]
    leads = lists.groupBy("key", "band").agg(*picks)

    def plain(c: str) -> Column:
        size = F.col(f"{c}_sized")
        return F.struct(F.col(f"{c}_s1").alias("s1"), size.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"), F.shiftright(size, 32).alias("m"))

    leads = C.materialise(leads.select("key", "band", F.array_distinct(F.array(*map(plain, orders))).alias("leads")), "leads")
    banded = lists.join(leads, ["key", "band"])
    near = F.expr(f"filter(leads, x -> x.s1 <> s1 and {_may_link('n', 'x.n', 'least(m, x.m)')})")
    across = F.when((F.col("s1") == F.col("leads")[0]["s1"]) & (F.col("s1") != F.col("pivot")), F.array(F.struct(F.col("pivot").alias("s1"), F.col("pivot_n").alias("n"), "m")))
    to = F.concat(near, F.coalesce(across, F.array().cast("array<struct<s1:bigint,n:int,m:bigint>>")))
    starred = banded.select("s1", "n", F.explode(to).alias("to"))
    return starred.groupBy("s1", "n", F.col("to.s1").alias("pivot"), F.col("to.n").alias("pivot_n")).agg(F.count(F.lit(1)).alias("lists"))


def _open_pairs(named: DataFrame) -> DataFrame:
    """(a, b, na, nb): pairs of sets in different components that may still be linked.

    ``named`` has a row (key, n, cid, component) for each set on a list. A pair that may be linked
    shares some number t of open lists, which its sizes give; then the smallest list that it shares
    is among the first m - t + 1 of the m open lists of either, in ascending order of their sizes,
    and only there it is looked for. For a set of size n at place r of its m lists this leaves t <=
    m - r, so that a larger partner has at least (12 n - 28 (m - r) + 7) / 9 shingles, and 4 n / 3
    at most: the set meets the buckets of those sizes, each partner is in one.
    """
    of_list = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("members"))
    of_list = C.materialise(of_list.where("c0 < c1").select("key", "members"), "open")
    named = named.join(of_list, "key")
    of = Window.partitionBy("cid")  # a set's own lists
    named = named.withColumn("m", F.count(F.lit(1)).over(of)).withColumn("rank", F.row_number().over(of.orderBy("members", "key")) - 1)
    named = C.materialise(named, "open")
    side = lambda p: [F.col("cid").alias(p), *(F.col(c).alias(f"{c}{p}") for c in ("n", "m", "rank", "component"))]
    least = F.greatest(F.col("n"), F.expr("cast(floor((12 * n - 28 * (m - rank) + 7) / 9) as int)"))
    most = F.expr("4 * n div 3")
    small = named.withColumn("least", least).withColumn("most", most).where("least <= most")
    small = small.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("least")), _bucket(F.col("most")))))
    # the largest partner of a bucket needs the fewest common lists, but for a rounding of one: at a later place the bucket has no partner
    small = small.withColumn("top", F.least("most", F.ceil(F.pow(F.lit(BUCKET), F.col("bucket") + 1)).cast("int") + 1))
    small = small.where(F.expr(f"rank + greatest({_LISTS_NEEDED.format(a='n', b='top')} - 1, 1) <= m")).select("key", *side("a"), "bucket")
    large = named.select("key", *side("b"), _bucket(F.col("n")).alias("bucket"))
    shared = F.expr(f"greatest({_LISTS_NEEDED.format(a='na', b='nb')}, 1)")
    pairs = small.join(large, ["key", "bucket"]).where("(na < nb or (na = nb and a < b)) and componenta <> componentb and 3 * nb <= 4 * na")
    pairs = pairs.where((F.col("ranka") + shared <= F.col("ma")) & (F.col("rankb") + shared <= F.col("mb"))).select("a", "b", "na", "nb").distinct()
    on = named.groupBy("cid").agg(F.collect_set("key").alias("keys"))
    for p in "ab":
        pairs = pairs.join(on.select(F.col("cid").alias(p), F.col("keys").alias(f"keys_{p}")), p)
    pairs = pairs.withColumn("lists", F.size(F.array_intersect("keys_a", "keys_b"))).where(_may_link("na", "nb", "lists"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb")


def jaccard_join(docs: DataFrame, words: int = WORDS, links: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, did, rid, n_shingles, component_id, class_id, n_links, component).

    ``component_id`` and ``class_id`` are the smallest ids of the component and of the rows with the
    same set; ``component`` is the component's own number, null for an empty set; ``n_links`` counts
    all other classes that the row's class is linked to. Where only components are asked for
    (``links`` false) there is no such column, and pairs within a component are not all compared.
    """
    spark, rows = docs.sparkSession, C.keyed(docs)
    found = C.materialise(signatures(docs, words), "sets")
    sets = found.where("s2 is not null")
    # classes: equal sets, told apart by two sums and the size
    name = F.min(F.struct(*C.KEY))
    classes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("class_id"), name.alias("row"))
    classes = C.materialise(classes.select("s1", "s2", "n", "class_id", "row.*", F.monotonically_increasing_id().alias("cid")), "classes")
    keep = C.tables(spark)
    sizes = {r.n: r.times for r in classes.where(f"n <= {2 * LIGHT_MOST}").groupBy("n").agg(F.count(F.lit(1)).alias("times")).collect()}
    x = boundary(sizes)
    repeated = C.materialise(found.where("s2 is null").groupBy("s1").agg(F.sum("n").alias("times")), "repeated")
    top = C.most_frequent(repeated, "times", FREQUENT).toArrow()
    times, shingles = top.column("times").to_numpy(), top.column("s1").to_numpy()
    frequent = shingles[np.lexsort((shingles, times))].view(np.uint64)

    listed = C.materialise(entries(docs, frequent, x, words), "entries")
    members_at = C.scratch_path(spark, "members")
    for part in range(PARTS):
        some = listed.where(F.pmod("key", F.lit(PARTS)) == part)
        # the key first: sorts compare by their first column, which hardly ever ties then
        shared = some.groupBy("key", "kind").agg(F.min("s1").alias("low"), F.max("s1").alias("high"), F.min_by("s1", "n").alias("pivot"), F.min("n").alias("pivot_n"))
        shared = C.materialise(shared.where("low < high").select("key", "kind", "pivot", "pivot_n"), "shared")
        # several tasks may list one set
        members = C.written(some.join(shared, ["key", "kind"]).distinct(), members_at, "append")
    C.clear(spark, keep=[*keep, members_at])

    # s1 and n name a class in the lists; should two classes have the same, both are tested
    names = classes.select("s1", F.col("n").cast("int").alias("n"), "cid")
    light = members.where("kind > 0 and s1 <> pivot and pivot_n = kind div 1000").select("s1", "n", "pivot", "pivot_n").distinct()
    lists = members.where("kind = 0").drop("kind")
    first = _named(_lists(lists), names).where(_may_link("na", "nb", f"{SLACK} * lists")).select("a", "b")
    tested_at = C.scratch_path(spark, "tested")
    tested = C.written(_test(first.union(_named(light, names).select("a", "b")).distinct(), rows, classes, words), tested_at)
    keep += [tested_at]
    C.clear(spark, keep=[*keep, members_at])
    edges = _linked(tested)
    label = components(edges)
    keep = [t for t in C.tables(spark) if t != members_at]

    named = lists.select("key", "s1", "n").join(names, ["s1", "n"]).join(label, F.col("cid") == F.col("node"), "left")
    named_at, more_at = C.scratch_path(spark, "named"), C.scratch_path(spark, "tested")
    named = C.written(named.select("key", "n", "cid", F.coalesce("component", "cid").alias("component")), named_at)
    C.clear(spark, keep=[*keep, named_at, more_at])
    more = _open_pairs(named).join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    more = C.written(_test(more, rows, classes, words), more_at)
    C.clear(spark, keep=[*keep, more_at])
    if not _linked(more).isEmpty():
        edges = edges.union(_linked(more))
        label = components(edges)

    counted = []
    labelled = classes.join(label, F.col("cid") == F.col("node"), "left")
    if links:
        keep, links_at = C.tables(spark), C.scratch_path(spark, "links")
        labelled = labelled.join(C.written(_links(classes, label, rows, words), links_at), "cid", "left")
        C.clear(spark, keep=[*keep, links_at])
        counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    classes = C.materialise(labelled.select("s1", "s2", "n", "class_id", F.coalesce("component", "cid").alias("component"), *counted), "labelled")
    smallest = C.materialise(classes.groupBy("component").agg(F.min("class_id").alias("component_id")), "smallest")
    classes = C.materialise(classes.join(smallest, "component"), "labelled")
    out = sets.join(classes, ["s1", "s2", "n"], "left")
    own = F.col("component").isNull()
    pick = lambda c: F.when(own, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", *C.KEY, F.col("n").alias("n_shingles"), pick("component_id"), pick("class_id"), *counted, "component")


def _links(classes: DataFrame, label: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(cid, n_links) of the classes in components: all pairs of a component whose sizes allow a link are compared.

    Two that are a component are linked. Larger ones are dealt into blocks within bands of sizes, and
    each pair of blocks of one band or of neighbours is a unit of work, so that a text goes once to a
    block and not once to a pair, and no task holds more than a block, however large the component.
    """
    members = classes.join(label, F.col("cid") == F.col("node")).select("cid", *C.KEY, "n", "component")
    times = label.groupBy("component").agg(F.count(F.lit(1)).alias("times"))
    members = members.join(times, "component").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int"))
    members = C.materialise(members, "members")
    large = members.where("times > 2")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    dealt = large.join(large.groupBy("component", "band").agg(blocks), ["component", "band"])
    dealt = C.materialise(dealt.select("cid", *C.KEY, "component", "band", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block")), "dealt")
    place = ["component", "band", "block"]
    held = dealt.select(*place).distinct()
    met = held.select("component", F.col("band").alias("other_band"), F.col("block").alias("other"))
    pairs = held.withColumn("other_band", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(met, ["component", "other_band"]).where("other_band > band or other >= block")
    pairs = C.materialise(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    own = F.expr("other_band = band and other = block")
    left = pairs.select(*place, "pair", F.when(own, OWN_SIDE).otherwise(HELD_SIDE).alias("side"))
    right = pairs.where(~own).select("component", F.col("other_band").alias("band"), F.col("other").alias("block"), "pair", F.lit(MET_SIDE).alias("side"))
    sent = left.union(right).join(dealt, place).select("pair", "side", "cid")
    texts = rows.join(C.bounded_broadcast(dealt.select("cid", *C.KEY), BROADCAST_IDS), C.KEY).select("cid", "text")
    texts = C.materialise(texts.dropDuplicates(["cid"]), "texts")  # a row may be repeated
    sent = sent.join(texts, "cid").select("pair", "side", "cid", "text")
    counts = link_counts(sent.repartition("pair").sortWithinPartitions("pair", "side"), words).groupBy("cid").agg(F.sum("links").alias("n_links"))
    return counts.union(members.where("times = 2").select("cid", F.lit(1).cast("long").alias("n_links")))


def _named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of classes a < b for pairs of signatures (s1, n, pivot, pivot_n), with the lists that each was found on."""
    left = names.select("s1", "n", F.col("cid").alias("x"))
    right = names.select(F.col("s1").alias("pivot"), F.col("n").alias("pivot_n"), F.col("cid").alias("y"))
    both = pairs.join(left, ["s1", "n"]).join(right, ["pivot", "pivot_n"]).where("x <> y")
    lists = F.col("lists") if "lists" in pairs.columns else F.lit(1)
    low = F.col("x") < F.col("y")
    sized = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(low, F.col("n")).otherwise(F.col("pivot_n")).alias("na"), F.when(low, F.col("pivot_n")).otherwise(F.col("n")).alias("nb"), lists.alias("lists"))
    return sized.groupBy("a", "b", "na", "nb").agg(F.sum("lists").alias("lists"))


def _test(pairs: DataFrame, rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """Compare the texts of the pairs' classes, each by one of its rows. Only texts that some pair names are moved."""
    pairs = C.materialise(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    named = C.materialise(classes.select("cid", *C.KEY).join(named, "cid"), "compared")
    texts = rows.join(C.bounded_broadcast(named, BROADCAST_IDS), C.KEY).select("cid", "text")
    texts = C.materialise(texts.dropDuplicates(["cid"]), "texts")  # a row may be repeated
    # a pair is tested where the end that is in more pairs is: its text goes there once for HUB_MEMBERS others
    times = C.materialise(pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("times")), "times")
    of = lambda p: times.select(F.col("cid").alias(p), F.col("times").alias(f"t{p}"))
    more = F.col("ta") >= F.col("tb")
    hub, member = (F.when(more, F.col(p)).otherwise(F.col(q)) for p, q in ("ab", "ba"))
    pieces = F.ceil(F.greatest("ta", "tb") / HUB_MEMBERS)
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select(hub.alias("hub"), F.pmod(F.xxhash64(member), pieces).alias("piece"), member.alias("member"))
    dealt = C.materialise(dealt, "dealt")
    members = dealt.select("hub", "piece", "member", F.col("member").alias("cid"))
    hubs = dealt.select("hub", "piece").distinct().select("hub", "piece", F.lit(None).cast("long").alias("member"), F.col("hub").alias("cid"))
    rows = members.union(hubs).join(texts, "cid").select("hub", "piece", "member", "text")
    rows = rows.repartition("hub", "piece").sortWithinPartitions("hub", "piece", F.col("member").asc_nulls_first())
    return overlaps(rows, words)


def _linked(tested: DataFrame) -> DataFrame:
    return tested.where("7 * common >= 3 * (na + nb) and common > 0").select("a", "b")
