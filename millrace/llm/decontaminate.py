"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one window). A
window is the set of its 3-word shingles. Shingles are ordered by how often they occur in all
documents, rarest first. A document that contains a window contains all of its shingles, so at a
containment of 1 the necessary prefix is the rarest shingle alone: the join looks up only that
one. A match at word p of a document with the prefix shingle at offset o of a window of L words
is kept if the window fits (0 <= p - o, p - o + L <= words of the document), then the L words
from p - o are compared with the window's, first by hash, then byte for byte.

A benchmark of up to ``BROADCAST_BYTES`` is broadcast and documents aren't shuffled. A larger one is a
table: documents emit how often they have its shingles, every window picks its prefix by a join with
these counts, and documents then emit the places of prefix shingles with the few words around them,
which meet their windows by a join and are compared there word for word. That takes three scans of
the documents whatever the benchmark's size. Up to ``FILTER_KEYS`` distinct shingles are broadcast so
that documents emit no others; beyond, the join alone decides.

Defined cases: null and empty texts have no words; items with no words or a null id match nothing;
repeated items count once per id; repeated documents, and those without an id, each get a row; texts
and words of any length are read whole; with an empty benchmark nothing is hit, an empty table gives
an empty one; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

WINDOW = 10
SHINGLE = 3
BROADCAST_BYTES = 8 << 20
#: Shingles of a larger benchmark that are broadcast as a sorted array, eight bytes each.
FILTER_KEYS = 1 << 23


def _normal(text: str) -> np.ndarray:
    return C.LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def words_of(text: str) -> list[bytes]:
    data = _normal(text)
    s, e, _ = C.word_spans(data, np.array([0, len(data)]), C.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]


def shingle_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (across documents; callers check the bounds)."""
    n = max(0, len(word_hash) - k + 1)
    at = np.arange(n)
    return C.sequence_hashes(word_hash, at, k)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return C.span_hashes(data, off[:-1], off[1:])


class Windows:
    """The windows of a small benchmark, each distinct word sequence once."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW) -> None:
        of: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                of[tuple(words[i : i + size])].add(item)
        self.words = list(of)
        self.items = [sorted(x) for x in of.values()]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.shingles: list[np.ndarray] = []
        hashes = []
        for w in self.words:
            h = _word_hashes(list(w))
            self.shingles.append(shingle_hashes(h, min(SHINGLE, len(w))))
            hashes.append(shingle_hashes(h, len(w))[0])
        self.hash = np.array(hashes, np.uint64)

    def sizes(self) -> list[int]:
        return sorted({min(SHINGLE, int(n)) for n in self.length})

    def all_shingles(self) -> np.ndarray:
        return np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)

    def prefixes(self, frequency: dict[int, int]) -> None:
        """Keep each window's rarest shingle (ties: the smaller hash, then the first place)."""
        keys, offsets = [], []
        for s in self.shingles:
            best = min(range(len(s)), key=lambda i: (frequency.get(int(s[i]), 0), int(s[i]), i))
            keys.append(s[best])
            offsets.append(best)
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.key, begin, self.fan = np.unique(keys[order], return_index=True, return_counts=True)
        self.begin, self.window, self.offset = begin, order, np.array(offsets, np.int64)[order]
        self.shingles = []


def _scan(column) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges: bytes, word starts and ends, each row's first word, word hashes."""
    data, offsets = C.bytes_of(column)
    for i, j in C.steps(offsets):
        part = C.LOWER[data[offsets[i] : offsets[j]]]
        s, e, first = C.word_spans(part, offsets[i : j + 1] - offsets[i], C.ALNUM)
        yield i, j, part, s, e, first, C.span_hashes(part, s, e)


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h that hold a key, and which."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # most words are no candidates: a table of 2**16 marks drops them before the search
    mark = np.zeros(1 << 16, bool)
    mark[(keys >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(mark[(h >> np.uint64(48)).astype(np.int64)])
    k = np.searchsorted(keys, h[at])
    k[k == len(keys)] = 0
    hit = keys[k] == h[at]
    return at[hit], k[hit]


def shingle_frequencies(docs: DataFrame, shingles: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """How often each of the given shingles occurs in all documents; one row per shingle comes back."""
    known = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for _, _, _, _, _, first, h in _scan(batch.column("text")):
                for k in sizes:
                    at, which = _find(known.value, shingle_hashes(h, k))
                    row_end = first[np.searchsorted(first, at, "right")]
                    total += np.bincount(which[at + k <= row_end], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["which", "n"])

    rows = C.map_arrow(docs.select("text"), run, "which int, n long").groupBy("which").agg(F.sum("n").alias("n")).collect()
    return {int(shingles[r.which]): r.n for r in rows}


def _hits(docs: DataFrame, windows: Windows) -> DataFrame:
    """(doc_id, did, rid, n_words, spans, items) for each document: disjoint ascending spans of hit words."""
    known = docs.sparkSession.sparkContext.broadcast(windows)
    sizes = windows.sizes()
    own = ["doc_id", *C.KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = known.value
        for batch in batches:
            for i, j, part, s, e, first, h in _scan(batch.column("text")):
                n_rows = j - i
                found_at, found = [], []
                for k in sizes:
                    at, which = _find(w.key, shingle_hashes(h, k))
                    group, place = C.runs_of(w.fan[which])
                    entry = w.begin[which][group] + place
                    window, start = w.window[entry], at[group] - w.offset[entry]
                    row = np.searchsorted(first, at[group], "right") - 1
                    fits = (np.minimum(w.length[window], SHINGLE) == k) & (start >= first[row]) & (start + w.length[window] <= first[row + 1])
                    window, start = window[fits], start[fits]
                    same = C.sequence_hashes(h, start, w.length[window]) == w.hash[window]
                    found_at.append(start[same])
                    found.append(window[same])
                start, window = np.concatenate(found_at) if found_at else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, np.int64)
                items: list[set] = [set() for _ in range(n_rows)]
                cover = np.zeros(len(s) + 1, np.int64)
                raw = part.tobytes() if len(start) else b""
                rows = np.searchsorted(first, start, "right") - 1
                for p, v, r in zip(start.tolist(), window.tolist(), rows.tolist()):
                    words = w.words[v]
                    if all(raw[s[p + q] : e[p + q]] == x for q, x in enumerate(words)):
                        cover[p] += 1
                        cover[p + len(words)] -= 1
                        items[r].update(w.items[v])
                inside = np.cumsum(cover[:-1]) > 0
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                begins[first[:-1][first[:-1] < len(s)]] |= inside[first[:-1][first[:-1] < len(s)]]
                stops = inside.copy()
                stops[:-1] &= ~inside[1:]
                last = first[1:][first[1:] > 0] - 1
                stops[last] |= inside[last]
                b, t = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                per_row = np.searchsorted(b, first)
                owner = np.searchsorted(first, b, "right") - 1
                spans = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.StructArray.from_arrays([pa.array(b - first[owner]), pa.array(t - first[owner])], ["start", "end"]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, n_rows) for c in own), pa.array(np.diff(first)), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    [*own, "n_words", "spans", "items"],
                )

    return C.map_arrow(docs, run, "doc_id long, did long, rid long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: (doc_id, did, rid, n_words, spans, items): spans of hit words (end exclusive) and ids of the items that hit."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    rows = C.keyed(docs)
    if size > broadcast_bytes:
        return _shuffled(rows, items, window)
    windows = Windows([(r.item_id, r.text) for r in items.collect()], window)
    shingles = windows.all_shingles()
    windows.prefixes(shingle_frequencies(rows, shingles, windows.sizes()) if len(shingles) else {})
    return _hits(rows, windows)


# --- a benchmark too large to broadcast ----------------------------------------------------------


def _items_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, win): the windows of all items, as words with one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = [w.decode("utf-8", "replace") for w in words_of(text)]
                own = {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1) if words else 0)}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(list(own), pa.string())], ["item_id", "win"])

    return C.map_arrow(items, run, "item_id string, win string")


def _windows_shingles(windows: DataFrame) -> DataFrame:
    """(win, n, offset, shingle) of each window's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wins, sizes, offsets, hashes = [], [], [], []
            for win in batch.column("win").to_pylist():
                words = win.encode().split(b" ")
                own = shingle_hashes(_word_hashes(words), min(SHINGLE, len(words)))
                wins += [win] * len(own)
                sizes += [len(words)] * len(own)
                offsets += range(len(own))
                hashes.append(own)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.string()), pa.array(sizes, pa.int32()), pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))], ["win", "n", "offset", "shingle"])

    return C.map_arrow(windows, run, "win string, n int, offset int, shingle long")


def _known(shingles: DataFrame):
    """A broadcast sorted array of a written table's distinct ``shingle``, or None if they are too many."""
    if shingles.count() > FILTER_KEYS:
        return None
    found = np.sort(shingles.toArrow().column("shingle").to_numpy().view(np.uint64))
    return shingles.sparkSession.sparkContext.broadcast(found)


def _places(h: np.ndarray, first: np.ndarray, k: int, known) -> tuple[np.ndarray, np.ndarray]:
    """Places of k-word shingles inside one document each that may be wanted, and their hashes."""
    s = shingle_hashes(h, k)
    at = np.arange(len(s)) if known is None else _find(known.value, s)[0]
    at = at[at + k <= first[np.searchsorted(first, at, "right")]] if len(at) else at
    return at, s[at]


def _counts(rows: DataFrame, sizes: list[int], known) -> DataFrame:
    """(shingle, times): how often shingles occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, _, first, h in _scan(batch.column("text")):
                found, times = np.unique(np.concatenate([_places(h, first, k, known)[1] for k in sizes]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["shingle", "times"])

    return C.map_arrow(rows.select("text"), run, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))


def _around(rows: DataFrame, sizes: list[int], known, window: int) -> DataFrame:
    """(row, at, lead, words, shingle): places of prefix shingles with the words that a window around them may have, ``lead`` of them before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, part, s, e, first, h in _scan(batch.column("text")):
                raw = part.tobytes()
                for k in sizes:
                    at, keys = _places(h, first, k, known)
                    if not len(at):
                        continue
                    row = np.searchsorted(first, at, "right") - 1
                    begin, end = np.maximum(first[row], at - (window - k)), np.minimum(first[row + 1], at + window)
                    words = [b" ".join([raw[p:q] for p, q in zip(s[a:b].tolist(), e[a:b].tolist())]).decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist())]
                    columns = [batch.column("row").take(pa.array(i + row)), pa.array(at - first[row]), pa.array((at - begin).astype(np.int32)), pa.array(words, pa.string()), pa.array(keys.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "at", "lead", "words", "shingle"])

    return C.map_arrow(rows.select("row", "text"), run, "row long, at long, lead int, words string, shingle long")


def _lengths(rows: DataFrame) -> DataFrame:
    own = ["row", "doc_id", *C.KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, _, first, _ in _scan(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in own), pa.array(np.diff(first))], [*own, "n_words"])

    return C.map_arrow(rows.select(*own, "text"), run, "row long, doc_id long, did long, rid long, n_words long")


def merged_spans(spans: Column) -> Column:
    """Sorted spans (start, end) with those that overlap or touch made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        return F.when((F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < x["start"]), F.array_append(done, x)).otherwise(grown)

    return F.aggregate(spans, none, add)


def _shuffled(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    rows = C.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    of_item = C.materialise(_items_windows(items, window), "windows")
    shingles = C.materialise(_windows_shingles(of_item.select("win").distinct()), "shingles")
    sizes = sorted(r.k for r in shingles.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most SHINGLE
    if not sizes:
        return _hits(rows, Windows([]))
    counts = _counts(rows, sizes, _known(C.materialise(shingles.select("shingle").distinct(), "shingles")))
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)), "shingle", "offset"))
    prefix = shingles.join(counts, "shingle", "left").groupBy("win", "n").agg(rarest.alias("best"))
    prefix = C.materialise(prefix.select("win", "n", "best.shingle", "best.offset"), "prefixes")
    places = _around(rows, sizes, _known(C.materialise(prefix.select("shingle").distinct(), "shingles")), window)
    there = F.slice(F.split("words", " "), F.col("lead") - F.col("offset") + 1, F.col("n"))
    found = places.join(prefix, "shingle").where("lead >= offset").where(F.array_join(there, " ") == F.col("win"))
    found = C.materialise(found.select("row", "win", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("n")).alias("end")).distinct(), "hits")
    spans = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    named = found.select("row", "win").distinct().join(of_item, "win").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = _lengths(rows).join(spans, "row", "left").join(named, "row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", *C.KEY, "n_words", F.when(F.col("spans").isNull(), none).otherwise(merged_spans(F.col("spans"))).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
