"""Exact dedup with a log-structured merge index.

A task keeps a memtable of digests; when it is full, or its input ends, the memtable is flushed as
a run of rows sorted by digest, one for each distinct digest, with the identifier that ranks first
and the number of texts. Compaction merges all runs, one row per digest: a memtable has already
folded the copies of a hot text, so no group grows with its copies.

A digest that stands for more than one row is a hit. The hits are a compacted level of their own, in
sorted runs that each have a range of digests and a Bloom filter. ``lookup`` reads the texts again and
asks the filter of the one run that a digest can be in, so that only texts that are hits (and a
hundredth of the others) leave their task. These are verified byte for byte: the hash of all bytes
decides nothing alone. Each hit's bytes meet those of its group's other rows, first in the task, then
across tasks; a digest whose texts differ is split (for SHA-256 none is known).

Defined cases: a null text is an empty one; among rows of one identifier and one text one is kept
(``row``, a number given when the digests are written, breaks the tie); a null identifier ranks last;
texts of any length are compared whole; an empty table gives an empty one; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Distinct digests that a memtable holds.
MEMTABLE = 200_000
#: A filter's bits for each digest of its run, and the bits that a digest sets.
BITS, PLACES = 10, 4
#: Bytes of filters that are broadcast at a time; beyond, the texts are read in several passes.
FILTER_BYTES = 64 << 20


def normalise(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased, nothing else (bytes.lower is ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about a step's bytes, so that few texts are Python objects at a time."""
    _, offsets = C.bytes_of(batch.column("text"))
    for i, j in C.steps(offsets):
        yield batch.slice(i, j - i)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def digests(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """Rows (did, rid, doc_id, digest, second, row): ``second`` is a shorter digest of another family; did and rid name a row by its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                found = [normalise(t) for t in part.column("text").to_pylist()]
                second = [hashlib.blake2b(t, digest_size=12).digest() for t in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array([digest(t) for t in found], pa.binary()), pa.array(second, pa.binary())], [*own, "digest", "second"])

    own = [*C.KEY, "doc_id"]
    return C.map_arrow(C.keyed(docs), run, "did long, rid long, doc_id long, digest binary, second binary").withColumn("row", F.monotonically_increasing_id())


def runs(digest_rows: DataFrame, keep: str = "largest", memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs (run, digest, keep_id, keep_row, n). ``keep`` says which identifier ranks first."""
    sign = -1 if keep == "largest" else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        number = TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            keys = sorted(table)
            best = [table[k][0] for k in keys]
            columns = [pa.array([number] * len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array([None if b[0] else sign * b[1] for b in best], pa.int64()), pa.array([sign * b[2] for b in best], pa.int64()), pa.array([table[k][1] for k in keys], pa.int64())]
            table.clear()
            return pa.RecordBatch.from_arrays(columns, ["run", "digest", "keep_id", "keep_row", "n"])

        for batch in batches:
            for row, i, d in zip(*(batch.column(k).to_pylist() for k in ("row", "doc_id", "digest"))):
                rank = (i is None, 0 if i is None else sign * i, sign * row)
                got = table.get(d)
                if got is None:
                    table[d] = [rank, 1]
                    if len(table) >= memtable:
                        yield flush()
                        number += 1
                else:
                    got[1] += 1
                    if rank < got[0]:
                        got[0] = rank
        if table:
            yield flush()

    return C.map_arrow(digest_rows.select("row", "doc_id", "digest"), run, "run long, digest binary, keep_id long, keep_row long, n long")


def compact(run_rows: DataFrame, keep: str = "largest") -> DataFrame:
    """Merge runs: (digest, keep_id, keep_row, n). Partial aggregation merges the runs of a task before the shuffle."""
    # a null identifier ranks last; structs compare field by field
    rank = F.struct(F.col("keep_id").alias("keep_id"), F.col("keep_row").alias("keep_row"))
    best = F.max(rank) if keep == "largest" else F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "keep_row"))
    return run_rows.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("n")).select("digest", "best.keep_id", "best.keep_row", "n")


def _places(digests: list[bytes]) -> np.ndarray:
    """PLACES numbers of 64 bits for each digest: its first bytes, zeros if it is shorter."""
    size = 8 * PLACES
    return np.frombuffer(b"".join([d[:size].ljust(size, b"\0") for d in digests]), "<u8").reshape(-1, PLACES)


def filters(hits: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """(low, high, bits): the digests of ``hits`` in sorted runs of at most ``memtable``, each with its range and Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            marks = np.zeros(1 << max(6, (BITS * len(held) - 1).bit_length()), bool)
            marks[(_places(held) % np.uint64(len(marks))).astype(np.int64).ravel()] = True
            columns = [[held[0]], [held[-1]], [np.packbits(marks, bitorder="little").tobytes()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["low", "high", "bits"])

        for batch in batches:
            for d in batch.column("digest").to_pylist():
                held.append(d)
                if len(held) >= memtable:
                    yield flush()
        if held:
            yield flush()

    return C.map_arrow(hits.select("digest").repartitionByRange("digest").sortWithinPartitions("digest"), run, "low binary, high binary, bits binary")


class Filters:
    """The filters of all runs; their ranges are disjoint."""

    def __init__(self, runs: list[tuple[bytes, bytes, bytes]]) -> None:
        runs = sorted(runs)
        self.low, self.high = [r[0] for r in runs], [r[1] for r in runs]
        self.bits = [np.frombuffer(r[2], np.uint8) for r in runs]

    def maybe(self, digests: list[bytes]) -> list[bool]:
        """False for digests that are in no run."""
        out = np.zeros(len(digests), bool)
        of = np.array([bisect_right(self.low, d) - 1 for d in digests], np.int64)
        inside = np.flatnonzero(of >= 0)
        inside = inside[[digests[i] <= self.high[of[i]] for i in inside.tolist()]] if len(inside) else inside
        for k in np.unique(of[inside]).tolist():
            at, bits = inside[of[inside] == k], self.bits[k]
            place = (_places([digests[i] for i in at.tolist()]) % np.uint64(8 * len(bits))).astype(np.int64)
            out[at] = (bits[place >> 3] >> (place & 7) & 1).all(axis=1)
        return out.tolist()


def lookup(docs: DataFrame, hits: DataFrame, digest: Callable[[bytes], bytes] = sha256, filter_bytes: int = FILTER_BYTES, memtable: int = MEMTABLE) -> DataFrame:
    """Rows (digest, norm) of texts whose digest is among ``hits``: of each task's equal texts one, and any that differ.

    The hits' filters drop other texts before the shuffle. Where they have more than ``filter_bytes``
    together, the texts are read in several passes, each with the filters of a range of digests, one
    after the other: never more is broadcast, and only texts that may be hits are shuffled.
    """
    built = C.materialise(filters(hits, memtable), "filters")
    size = F.octet_length("bits") + F.octet_length("low") + F.octet_length("high")
    ranges: list[list] = []  # first digest and bytes of each pass
    for r in built.select("low", size.alias("size")).orderBy("low").collect():  # a row a run
        if not ranges or ranges[-1][1] + r.size > filter_bytes:
            ranges.append([bytes(r.low), 0])
        ranges[-1][1] += r.size

    def within(column: str, k: int):
        low = F.col(column) >= F.lit(ranges[k][0])
        return low & (F.col(column) < F.lit(ranges[k + 1][0])) if k + 1 < len(ranges) else low

    def passed(runs: DataFrame, wanted: DataFrame) -> DataFrame:
        known = docs.sparkSession.sparkContext.broadcast(Filters([tuple(map(bytes, r)) for r in runs.collect()]))
        return representatives(docs, digest, known).join(wanted.select("digest"), "digest", "left_semi")

    if len(ranges) < 2:
        return passed(built, hits)
    out = None
    for k in range(len(ranges)):
        part = C.materialise(passed(built.where(within("low", k)), hits.where(within("digest", k))), "looked-up")
        out = part if out is None else out.union(part)
    return out


def representatives(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, known=None, held_bytes: int = 16 << 20) -> DataFrame:
    """Rows (digest, norm): of each task's equal texts one, compared here byte for byte, and any that differ.

    ``known``: a broadcast of ``Filters``; texts that it rules out are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        size = 0
        for part in (p for batch in batches for p in _parts(batch)):
            out: list[tuple[bytes, bytes]] = []
            norms = [normalise(t) for t in part.column("text").to_pylist()]
            keys = [digest(t) for t in norms]
            wanted = known.value.maybe(keys) if known is not None else [True] * len(keys)
            for key, norm, ok in zip(keys, norms, wanted):
                if not ok:
                    continue
                got = held.get(key)
                if got is None:
                    held[key] = norm
                    size += len(norm)
                if got != norm:
                    out.append((key, norm))
                if size > held_bytes:
                    held, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["digest", "norm"])

    return C.map_arrow(C.id_and_text(docs), run, "digest binary, norm binary")


def _grouped(found: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    hits = C.materialise(compact(C.materialise(runs(found, keep), "runs"), keep).where("n > 1"), "hits")
    own = F.col("keep_row").isNull()
    # the copies of a hot text are one side's rows, which Spark splits; the other side has one row for them
    grouped = found.join(hits, "digest", "left").select(
        "row", "doc_id", *C.KEY, F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        (own | (F.col("row") == F.col("keep_row"))).alias("kept"), "digest", "second",
    )
    return grouped, hits.select("digest")


def _differ(texts: DataFrame) -> DataFrame:
    """Digests whose texts are not all equal."""
    return texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")


def exact_dedup(docs: DataFrame, keep: str = "largest", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per document: (doc_id, did, rid, keep_id, group_size, kept, digest).

    ``keep``: 'largest' or 'smallest' identifier of equal texts stays. A digest whose texts turn out
    to differ is split by ``second``; should bytes differ even then, the job fails rather than drop a text.
    """
    found = C.materialise(digests(docs, digest), "digests")
    grouped, hits = _grouped(found, keep)
    differ = C.materialise(_differ(lookup(docs, hits, digest)), "differ")
    if not differ.isEmpty():
        split = found.join(differ.withColumn("differs", F.lit(True)), "digest", "left")
        found = C.materialise(split.withColumn("digest", F.when(F.col("differs"), F.concat("digest", "second")).otherwise(F.col("digest"))).drop("differs"), "digests")
        grouped, hits = _grouped(found, keep)
        longer = lambda t: digest(t) + hashlib.blake2b(t, digest_size=12).digest()
        if not _differ(lookup(docs, hits, longer)).isEmpty():
            raise ValueError("two digests agree on different texts")
    return grouped.drop("row", "second")
