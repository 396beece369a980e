"""Token ids in entropy-coded files.

A file row is one segment: documents in ascending id order, about ``SEGMENT_IDS`` ids, coded
with a static range asymmetric numeral system. All blocks of a segment share its frequency
table; a block holds whole documents, has its own interleaved states (its checkpoint) and a
checksum, and an index in the segment's head says where each begins, so that a block decodes
without any other. Segments are rows of a Parquet table whose ``part`` and ``seq`` give their
order, so any store that Spark reads and writes will do. Segments are decoded side by side; where
they are fewer than the cores, the blocks of each are dealt to several tasks.

Shuffles: one, of the texts, into ranges of the id. Everything else is map-only; the offsets
come from a window over one row per partition of the table and one within each partition.

Defined cases: a null or empty text has the end id only; rows with the same id keep all their
rows, ordered by the text's hash; rows with a null id come first and keep it; an empty table gives
an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm import common as C

SEGMENT_IDS = 4_000_000
BLOCK_IDS = 1 << 18
LANES = 1024
#: Pre-tokens whose ids a worker keeps.
CACHE_ENTRIES = 700_000
#: Offsets of so many segments are broadcast at most.
BROADCAST_SEGMENTS = 1_000_000
MAGIC = b"MRANS2\0\0"
#: States are kept in [2**31, 2**63) and move 32 bits at a time.
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<8sIIIIQ")  # magic, bits of the scale, symbols, blocks, documents, ids
BLOCK = struct.Struct("<IIIII")  # documents, ids, lanes, words, crc32
#: A block's place in the segment's index: byte offset from the first block, first document, first id.
INDEX = np.dtype([("offset", "<u8"), ("document", "<u4"), ("id", "<u8")])

END_ID = 0


def scale_bits(symbols: int) -> int:
    return max(18, int(symbols).bit_length() + 2)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Positive integers that sum to 2**bits, about in proportion to the (positive) counts."""
    room = (1 << bits) - len(counts)
    f = 1 + (counts.astype(np.float64) * (room / counts.sum())).astype(np.int64)
    f[np.argmax(f)] += (1 << bits) - f.sum()
    return f


def encode_block(symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Final states and words of one block; symbol i belongs to lane i modulo the number of lanes."""
    lanes = int(min(LANES, max(1, len(symbols) // 32)))
    x = np.full(lanes, LOW, np.uint64)
    f_all, c_all = freq[symbols].astype(np.uint64), cum[symbols].astype(np.uint64)
    shift, limit = np.uint64(bits), np.uint64(63 - bits)
    out: list[np.ndarray] = []
    for at in range((len(symbols) - 1) // lanes * lanes, -1, -lanes):
        f, c = f_all[at : at + lanes], c_all[at : at + lanes]
        y = x[: len(f)]
        over = y >= (f << limit)
        if over.any():
            out.append(y[over].astype(np.uint32))
            y = np.where(over, y >> WORD, y)
        q = y // f
        x[: len(f)] = (q << shift) + (y - q * f) + c
    return x, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def decode_block(states: np.ndarray, words: np.ndarray, n: int, slots: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int) -> np.ndarray:
    x = states.astype(np.uint64)
    lanes, used = len(x), 0
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    f64, c64 = freq.astype(np.uint64), cum.astype(np.uint64)
    out = np.empty(n, np.int64)
    for at in range(0, n, lanes):
        m = min(lanes, n - at)
        y = x[:m]
        low = y & mask
        s = slots[low.astype(np.int64)]
        out[at : at + m] = s
        y = f64[s] * (y >> shift) + low - c64[s]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = y[need] << WORD | words[used : used + len(need)]
            used += len(need)
        x[:m] = y
    if used != len(words) or not (x == LOW).all():
        raise ValueError("a block does not end in its first state")
    return out


def encode_segment(doc_ids: pa.Array | np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment. Every document has at least its end id; a document's own id may be null."""
    doc_ids = pa.array(doc_ids, pa.int64())
    present, hist = np.unique(ids, return_counts=True)
    bits = scale_bits(len(present))
    freq = frequencies(hist, bits)
    cum = np.cumsum(freq) - freq
    dense = np.zeros(int(present[-1]) + 1, np.int64)
    dense[present] = np.arange(len(present))
    upto = np.concatenate([[0], np.cumsum(counts)])
    cuts, at = [], 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK_IDS, "right")) - 1)
        cuts.append((at, min(end, len(counts))))
        at = cuts[-1][1]
    blocks = []
    for a, b in cuts:
        part = ids[upto[a] : upto[b]]
        states, words = encode_block(dense[part], freq, cum, bits)
        blocks.append(BLOCK.pack(b - a, len(part), len(states), len(words), zlib.crc32(part.astype("<u4").tobytes())) + states.astype("<u8").tobytes() + words.astype("<u4").tobytes())
    index = np.zeros(len(cuts), INDEX)
    sizes = np.array([len(b) for b in blocks], np.int64)
    index["offset"], index["document"] = np.cumsum(sizes) - sizes, [a for a, _ in cuts]
    index["id"] = upto[index["document"]]
    table = zlib.compress(np.diff(present, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    known = np.array(doc_ids.is_valid(), np.uint8)
    names = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    rows = zlib.compress(names.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + known.tobytes(), 6)
    sizes = struct.pack("<QQ", len(table), len(rows))
    return b"".join([HEAD.pack(MAGIC, bits, len(present), len(blocks), len(counts), len(ids)), sizes, index.tobytes(), table, rows, *blocks])


def decode_segment(raw: bytes, slice_: int = 0, slices: int = 1) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Per block whose number is ``slice_`` modulo ``slices``: document ids, ids in each, ids end to end, ids of the segment before it."""
    raw = memoryview(raw)
    magic, bits, symbols, blocks, docs, _ = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    n_table, n_rows = struct.unpack_from("<QQ", raw, at)
    at += 16
    index = np.frombuffer(raw, INDEX, blocks, at)
    at += index.nbytes
    table = np.frombuffer(zlib.decompress(raw[at : at + n_table]), "<u4")
    present, freq = np.cumsum(table[:symbols].astype(np.int64)), table[symbols:].astype(np.int64)
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(symbols), freq)
    at += n_table
    rows = zlib.decompress(raw[at : at + n_rows])
    at += n_rows
    counts = np.frombuffer(rows, "<u4", docs, 8 * docs).astype(np.int64)
    doc_ids = pa.array(np.frombuffer(rows, "<i8", docs), pa.int64(), mask=np.frombuffer(rows, np.uint8, docs, 12 * docs) == 0)
    for offset, document, first in index[slice_::slices].tolist():
        place = at + offset
        n_docs, n, lanes, n_words, crc = BLOCK.unpack_from(raw, place)
        place += BLOCK.size
        states = np.frombuffer(raw, "<u8", lanes, place)
        words = np.frombuffer(raw, "<u4", n_words, place + 8 * lanes)
        ids = present[decode_block(states, words, n, slots, freq, cum, bits)].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block of token ids fails its checksum")
        yield doc_ids.slice(document, n_docs), counts[document : document + n_docs], ids, first


_library: dict[str, bpe.Encoder] = {}


def library_encoder(path: str) -> bpe.Encoder:
    """Ids as the tokenizers library gives them: each distinct pre-token goes through it once in a worker."""
    if path not in _library:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}

        # pre-tokens are found already, so they go to the library's model as the symbols that its vocabulary writes for bytes
        symbols, tokenize = str.maketrans(dict(enumerate(bpe.byte_symbols()))), t.model.tokenize

        def ids(pieces: list[bytes]) -> list[list[int]]:
            return [[x.id for x in tokenize(p.decode("latin-1").translate(symbols))] for p in pieces]

        _library[path] = bpe.Encoder(special, ids, CACHE_ENTRIES)
    return _library[path]


def segments(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Rows (part, seq, n_docs, n_tokens, segment) in ascending order of the documents' ids."""
    path = path or bpe.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc_ids, counts, ids = zip(*held)
            counts, ids = np.concatenate(counts), np.concatenate(ids)
            raw = encode_segment(pa.concat_arrays(doc_ids), counts, ids)
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_docs", "n_tokens", "segment"])

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for i, j, ids, counts in encoder.encode(batch.column("text")):
                held.append((doc_ids.slice(i, j - i), counts + 1, np.insert(ids, np.cumsum(counts), end_id)))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    ordered = C.id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return C.map_arrow(ordered, run, "part int, seq int, n_docs long, n_tokens long, segment binary")


def write(docs: DataFrame, to: str, path: str | None = None) -> None:
    segments(docs, path).write.option("compression", "none").parquet(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a written table: ``start`` counts the ids of all documents before."""
    table = spark.read.parquet(at)
    sizes = table.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    offsets = offsets.select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, part in zip(batch.column("first").to_pylist(), batch.column("segment"), batch.column("slice").to_pylist()):
                for doc_ids, counts, ids, before in decode_segment(raw.as_buffer(), part, slices):
                    start = first + before + np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(counts), C.binary_column(ids, counts)], ["doc_id", "start", "n_tokens", "ids"])

    n = sizes.count()
    if n <= BROADCAST_SEGMENTS:  # 16 bytes a segment; beyond, Spark joins as it finds best
        offsets = F.broadcast(offsets)
    joined = table.select("part", "seq", "segment").join(offsets, ["part", "seq"]).select("first", "segment")
    # fewer segments than cores: each goes to several tasks, which decode different blocks of it
    slices = max(1, -(-spark.sparkContext.defaultParallelism // max(n, 1)))
    joined = joined.select("first", "segment", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    if slices > 1:
        joined = joined.repartition(max(n, 1) * slices, "first", "slice")
    return C.map_arrow(joined, run, "doc_id long, start long, n_tokens long, ids binary")
