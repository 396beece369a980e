"""Substring dedup by compaction of a de Bruijn graph.

A window is ``WINDOW`` = K + W - 1 words. Of the W word k-mers (K words each) in a window one is
selected: the leftmost of the smallest hash. Equal windows select the same k-mer, so a window
that occurs twice leaves the same k-mer in both documents; about 2 of W + 1 k-mers are selected
and only those are shuffled. Selected k-mers that follow each other in a document are the edges
of the graph; they are at most W < K words apart, so an edge fixes all words between them.

1. A k-mer repeats if it is in two documents. It is nonbranching on a side if all its occurrences
   have the same neighbour at the same distance there (the ends of a document count as neighbours).
2. Joined back to the documents' coordinates, neighbours that are nonbranching towards each other
   run on: each maximal run is a compacted path, and every occurrence of one of its k-mers lies in
   an occurrence of the whole path.
3. A path of at least a window is one span to verify. Windows that hold a repeated k-mer but are
   not inside a path are verified one by one. Spans and windows are told apart by a 128-bit BLAKE2b
   digest of the bytes of all their words, and the smallest document of each is found. K-mers only
   choose what is verified: should two different ones have one hash, they branch.

What is shuffled: the selected k-mers twice, and the spans and windows. Texts are read again, and
joined to their paths and removed spans: by a broadcast of these up to the stated sizes, by a shuffle
of the texts beyond. Hot k-mers and windows are aggregated before the shuffle, and the joins back to
occurrences have one row for them on the other side, so that Spark can split them.

Defined cases: null and empty texts have no words; a window that repeats in its own document only is
kept; rows that share an id never remove each other's words; equal rows get equal results; a row
without an id has no place in the order, so it keeps all its words and removes none elsewhere; words
and texts of any length are taken whole; an empty table gives an empty one; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C

WINDOW = 50
#: Paths, or removed spans, that may be broadcast (some 40 bytes each).
BROADCAST_SPANS = 1_000_000

#: Columns of a place: the row (its id is never null here) and what the operator adds.
_ROW = ["did", "rid"]


def _scan(column) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = C.bytes_of(column)
    for i, j in C.steps(offsets):
        part = data[offsets[i] : offsets[j]]
        s, e, first = C.word_spans(part, offsets[i : j + 1] - offsets[i], C.SPACED)
        yield i, j, part, s, e, first, C.span_hashes(part, s, e)


class Selection:
    """Selected k-mers of a run of rows, laid end to end."""

    def __init__(self, words: np.ndarray, first: np.ndarray, window: int) -> None:
        w = window // 2
        k = window - w + 1
        n = np.maximum(np.diff(first) - window + 1, 0)
        self.row, place = C.runs_of(n)
        self.start = first[:-1][self.row] + place  # of each window
        self.k = k
        if not len(self.start):
            self.at = self.pos = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        m = np.arange(len(words) - k + 1)
        kmer = C.sequence_hashes(words, m, k)
        views = np.lib.stride_tricks.sliding_window_view(kmer, w)
        chosen = np.empty(len(self.start), np.int64)
        for a in range(0, len(chosen), 1 << 16):
            s = self.start[a : a + (1 << 16)]
            chosen[a : a + (1 << 16)] = s + views[s].argmin(axis=1)
        # of equal k-mers that follow each other word by word (one word, repeated) the first stands for all
        pos, back = np.unique(chosen, return_inverse=True)
        h = kmer[pos]
        new = np.ones(len(pos), bool)
        new[1:] = (h[1:] != h[:-1]) | (np.diff(pos) != 1)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.at = pos[head][back]  # of each window
        self.pos, self.hash = pos[new], h[new]


def digests(part: bytes, s: np.ndarray, e: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit digests, as two columns of 64 bits, of the runs of ``size`` words from word ``begin`` on, joined by one space."""
    # runs whose words have one space between them already are slices of the text
    if not len(begin):
        return np.zeros((0, 2), np.uint64)
    odd = (s[1:] - e[:-1] != 1) | (np.frombuffer(part, np.uint8)[e[:-1]] != 0x20)
    upto = np.concatenate([[0], np.cumsum(odd)])
    apart = np.flatnonzero(upto[begin + size - 1] != upto[begin])
    hashed = hashlib.blake2b
    out = [hashed(part[p:q], digest_size=16).digest() for p, q in zip(s[begin].tolist(), e[begin + size - 1].tolist())]
    for i in apart.tolist():
        a, n = begin[i], size[i]
        out[i] = hashed(b" ".join([part[p:q] for p, q in zip(s[a : a + n].tolist(), e[a : a + n].tolist())]), digest_size=16).digest()
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def _take(batch: pa.RecordBatch, i: int, row: np.ndarray) -> list[pa.Array]:
    """The row columns of rows i + row of a batch."""
    at = pa.array(i + row, pa.int64())
    return [batch.column(c).take(at) for c in _ROW]


def selected(rows: DataFrame, window: int) -> DataFrame:
    """(did, rid, pos, kmer, before, after): each selected k-mer with its neighbours, of rows that have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, _, _, first, words in _scan(batch.column("text")):
                x = Selection(words, first, window)
                row = np.searchsorted(first, x.pos, "right") - 1
                same = row[1:] == row[:-1]
                gap = np.diff(x.pos).astype(np.uint64)
                before, after = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
                before[1:][same] = C.mix(x.hash[:-1] + gap)[same]
                after[:-1][same] = C.mix(x.hash[1:] + gap)[same]
                columns = [*_take(batch, i, row), pa.array((x.pos - first[row]).astype(np.int32)), *(pa.array(v.view(np.int64)) for v in (x.hash, before, after))]
                yield pa.RecordBatch.from_arrays(columns, [*_ROW, "pos", "kmer", "before", "after"])

    return C.map_arrow(rows.where("doc_id is not null").select(*_ROW, "text"), run, "did long, rid long, pos int, kmer long, before long, after long")


def paths(rows: DataFrame, window: int) -> DataFrame:
    """(did, rid, paths): per row with repeated k-mers its compacted paths, as (start, last, end): first and last k-mer and the words' end."""
    edges = selected(rows, window)
    repeated = edges.groupBy("kmer").agg(
        F.min("did").alias("d0"), F.max("did").alias("d1"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1")
    )
    repeated = C.materialise(repeated.where("d0 < d1").select("kmer", F.expr("b0 = b1").alias("one_before"), F.expr("a0 = a1").alias("one_after")), "kmers")
    at = edges.select("kmer", *_ROW, "pos").join(repeated, "kmer").drop("kmer").distinct()
    w = Window.partitionBy(*_ROW).orderBy("pos")
    at = at.withColumn("breaks", F.when(F.col("one_before") & F.lag("one_after").over(w), 0).otherwise(1))
    at = at.withColumn("path", F.sum("breaks").over(w))
    k = window - window // 2 + 1
    found = at.groupBy(*_ROW, "path").agg(F.min("pos").alias("start"), F.max("pos").alias("last"))
    return found.groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("start", "last", (F.col("last") + k).alias("end")))).alias("paths"))


def sequences(with_paths: DataFrame, window: int) -> DataFrame:
    """(did, rid, start, times, size, h1, h2): spans and windows to verify; ``times`` windows from ``start`` on have the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("paths")
            for i, j, raw, word_start, word_end, first, words in _scan(batch.column("text")):
                x = Selection(words, first, window)
                part = lists.slice(i, j - i)
                flat = part.flatten()
                count = np.diff(part.offsets.to_numpy())
                owner, _ = C.runs_of(count)
                base = first[:-1][owner]
                start, last, end = (flat.field(f).to_numpy(zero_copy_only=False) + base for f in ("start", "last", "end"))
                # paths ascend, so the path of a k-mer is the last that starts at or before it
                of = np.searchsorted(start, x.at, "right") - 1
                inside = np.zeros(len(x.at), bool)
                if len(start):
                    ok = of >= 0
                    of = np.maximum(of, 0)
                    repeats = ok & (x.at <= last[of])
                    inside = repeats & ~((x.start >= start[of]) & (x.start + window <= end[of]))
                ws, wr = x.start[inside], x.row[inside]
                long = end - start >= window
                s = np.concatenate([start[long], ws])
                row = np.concatenate([owner[long], wr])
                size = np.concatenate([(end - start)[long], np.full(len(ws), window)])
                h1, h2 = digests(raw.tobytes(), word_start, word_end, s, size).T
                head = np.ones(len(s), bool)
                head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (np.diff(s) != 1) | (row[1:] != row[:-1]) | (size[1:] != size[:-1])
                keep = np.flatnonzero(head)
                times = np.diff(np.append(keep, len(s)))
                columns = [*_take(batch, i, row[keep]), pa.array((s - first[row])[keep].astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(size[keep].astype(np.int32)), *(pa.array(np.ascontiguousarray(h[keep]).view(np.int64)) for h in (h1, h2))]
                yield pa.RecordBatch.from_arrays(columns, [*_ROW, "start", "times", "size", "h1", "h2"])

    return C.map_arrow(with_paths.select(*_ROW, "text", "paths"), run, "did long, rid long, start int, times int, size int, h1 long, h2 long")


def removed_spans(rows: DataFrame, window: int) -> DataFrame:
    """(did, rid, removed): per row that loses words the spans (start, end) it loses, sorted; they may overlap."""
    found = C.materialise(paths(rows, window), "paths")
    total = found.agg(F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()[0]
    where = F.broadcast(found) if total <= BROADCAST_SPANS else found
    spans = C.materialise(sequences(rows.join(where, _ROW), window), "sequences")
    earliest = spans.groupBy("h1", "h2", "size").agg(F.min("did").alias("first_doc"), F.max("did").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    earliest = C.materialise(earliest, "earliest")  # so that the join has two plain shuffles, of which Spark can split the larger
    later = spans.join(earliest, ["h1", "h2", "size"]).where("did > first_doc")
    later = later.select(*_ROW, F.struct("start", (F.col("start") + F.col("times") - 1 + F.col("size")).alias("end")).alias("span"))
    return later.groupBy(*_ROW).agg(F.sort_array(F.collect_set("span")).alias("removed"))


def apply_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, n_words, removed, kept): disjoint removed spans of words (end exclusive), and the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("removed")
            for i, j, part, s, e, first, _ in _scan(batch.column("text")):
                raw = part.tobytes()
                removed, kept = [], []
                for r, spans in enumerate(lists.slice(i, j - i).to_pylist()):
                    a, b = int(first[r]), int(first[r + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    for x in spans or ():
                        gone[x["start"]] += 1
                        gone[x["end"]] -= 1
                    out = np.cumsum(gone[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                    removed.append([{"start": int(p), "end": int(q)} for p, q in zip(edge[::2], edge[1::2])])
                    at = np.flatnonzero(~out) + a
                    kept.append(b" ".join([raw[p:q] for p, q in zip(s[at].tolist(), e[at].tolist())]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "removed", "kept"],
                )

    return C.map_arrow(rows.select("doc_id", "text", "removed"), run, "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``; see ``apply_spans``."""
    rows = C.keyed(docs)
    found = C.materialise(removed_spans(rows, window), "removed")
    total = found.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    return apply_spans(rows.join(F.broadcast(found) if total <= BROADCAST_SPANS else found, _ROW, "left"))
