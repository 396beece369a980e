"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

T_ = TypeVar("T_")

#: Bytes of text that one vectorised step looks at (a longer document is one step of its own).
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only on one machine where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_millrace_dir", None)
        if root is None:
            root = spark._millrace_dir = tempfile.mkdtemp(prefix="spark-millrace-")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    spark._millrace_tables = [*getattr(spark, "_millrace_tables", ()), path]
    return path


def tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session's operators have written and not removed."""
    return list(getattr(spark, "_millrace_tables", ()))


def clear(spark: SparkSession, keep: Sequence[str] = ()) -> None:
    """Remove the tables that this session's operators wrote, less those at the paths to keep. Frames that read them can't be used any more."""
    keep = set(keep)
    for path in getattr(spark, "_millrace_tables", ()):
        if path not in keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._millrace_tables = [p for p in getattr(spark, "_millrace_tables", ()) if p in keep]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back with the same schema."""
    return written(df, scratch_path(df.sparkSession, name))


#: Spark's setting to remove a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write ``df`` and read it back; the shuffle files of the write, which nothing reads again, are removed with its end."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting of the bytes of rows in a batch for Python. Executor and worker hold a batch each, and the executor up to twice while it grows.
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on this session's batches for Python are of BATCH_BYTES at most (or one row), unless they are smaller already."""
    now = spark.conf.get(BATCHES)
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)) > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def bounded_broadcast(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Mark a written table of ids for broadcast if it has at most ``rows`` rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of highest count, at most ``limit`` of them: those above a count that a histogram of magnitudes gives.

    No task sees more than its own rows: a sort with a limit would bring ``limit`` rows of every task together.
    """
    size = F.floor(F.log2(count) * 16).cast("int")
    sizes = sorted(((r.size, r.n) for r in df.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for s, n in sizes:
        total += n
        if total > limit:
            break
        least = s
    kept = df.where(size >= least)
    if sizes and limit and least > sizes[0][0]:  # those of the highest magnitude alone are too many: a fixed part of them, by hash
        share = max(1, (1 << 20) * limit // sizes[0][1] * 9 // 10)
        kept = df.where((size == sizes[0][0]) & (F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) < share)).limit(limit)
    return kept


def _release() -> None:
    """Give freed memory back to the system: a Python worker stays, idle, after its task, and the executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: What this Python worker keeps between tasks, by the operator and a name of its own.
_kept: dict[tuple[str, str], object] = {}


def kept(operator: str, name: str, make: Callable[[], T_]) -> T_:
    """What ``make`` gave in this worker before; it goes with the worker's first task of another operator (see ``map_arrow``)."""
    key = (operator, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget_others(operator: str | None) -> None:
    """Drop what tasks of other operators keep: Spark gives the same worker to all of them."""
    others = [key for key in _kept if key[0] != operator]
    for key in others:
        del _kept[key]
    if others:
        _release()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str, operator: str | None = None) -> DataFrame:
    """``mapInArrow`` whose tasks leave no freed memory behind, and nothing ``kept`` but what ``operator`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(operator)
        yield from fn(batches)
        _release()

    return df.mapInArrow(run, ddl)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is an empty one."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: Columns that name a row by its id and text; never null.
KEY = ["did", "rid"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_and_text`` with KEY: the id (0 for none) and a hash of the text and of whether there is an id. Only rows of one id can collide."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", "text", *[c.alias(n) for c, n in zip(keyed_columns(), KEY)])


def keyed_columns() -> tuple[Column, Column]:
    """The values of KEY, from a table's own ``doc_id`` and ``text``."""
    doc_id = F.col("doc_id").cast("long")
    return F.coalesce(doc_id, F.lit(0)), F.xxhash64(doc_id.isNull(), F.coalesce("text", F.lit("")))


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def train_side(id_col: str = "doc_id"):
    """True for rows a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


# --- vectorised text scans -------------------------------------------------------------------


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Masks that keep the first k bytes of a little-endian word of 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Longer spans are hashed or compared one by one, by library code.
LONG_SPAN = 512


def words_of_eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of ``data`` as one little-endian word (zeros beyond its end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[s:e] of every span: eight bytes at a time are mixed in, one after the other.

    Every step is a bijection of what came before, so no pattern of contents cancels out. Spans of
    equal hash are still to be compared where equality decides a result.
    """
    size = ends - starts
    eight = words_of_eight(data)
    h = mix(eight[starts] & _FIRST[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _LENGTH
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    while len(more):
        left = size[more] - at
        place = starts[more] + np.minimum(at, size[more] - 8)  # the last word ends where the span does
        h[more] = mix(h[more] * _STEP + eight[place])
        at, more = at + 8, more[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return mix(h)


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Are the bytes of every span i those of span other[i]?"""
    size = ends - starts
    if not (size == size[other]).all():
        return False
    eight = words_of_eight(data)
    there = starts[other]
    if not ((eight[starts] ^ eight[there]) & _FIRST[np.minimum(size, 8)] == 0).all():
        return False
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    while len(more):
        step = np.minimum(at, size[more] - 8)
        if not (eight[starts[more] + step] == eight[there[more] + step]).all():
            return False
        at, more = at + 8, more[size[more] - at > 8]
    return all(np.array_equal(data[starts[i] : ends[i]], data[there[i] : there[i] + size[i]]) for i in np.flatnonzero(size > LONG_SPAN).tolist())


def sequence_hashes(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the entries h[s:s + size] (themselves hashes): each is multiplied by an odd number of its place, and the sum is mixed."""
    sizes = np.broadcast_to(sizes, len(starts))
    out = mix(sizes.astype(np.uint64) + np.uint64(salt))
    most = int(sizes.max()) if len(sizes) else 0
    factors = mix(np.arange(1, most + 1, dtype=np.uint64) * _STEP + np.uint64(salt)) | np.uint64(1)
    whole = int(sizes.min()) if len(sizes) else 0
    run = len(starts) > 1 and whole == most and bool((np.diff(starts) == 1).all())  # of every place on: no gathering
    for j in range(most):
        if run:
            out += h[starts[0] + j : starts[0] + j + len(starts)] * factors[j]
        elif j < whole:
            out += h[starts + j] * factors[j]
        else:
            more = np.flatnonzero(sizes > j)
            out[more] += h[starts[more] + j] * factors[j]
    return mix(out)


#: Word bytes of the pattern [^\x20\x09-\x0D]+ (separators are ASCII, so bytes decide).
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the index of its first word (n + 1 entries)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = is_word[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = m.copy()
    starts[1:] &= ~m[:-1] | first[1:n]
    ends = m.copy()
    ends[:-1] &= ~m[1:] | first[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def runs_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each element's group and its place in it."""
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return group, np.arange(total) - begin[group]


def binary_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next counts[i] entries of ``flat``."""
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * flat.itemsize, out=off[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
