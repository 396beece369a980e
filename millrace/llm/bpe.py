"""BPE encoding and decoding.

``encode`` finds the pre-tokens of a batch, merges every pre-token that this worker has not seen
yet with a segment tree over the ranks of its adjacent pairs, and lays the ids end to end;
``decode`` joins the bytes of the ids. Both are map-only: no shuffle, memory bounded by a batch
step and by the ``CACHE_ENTRIES`` pre-tokens that a worker keeps.

Defined cases: a null or empty text has no ids; equal rows give equal results; null and repeated ids
are passed on as they are; a very long text or word is encoded whole; an empty table gives an empty
one; only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common as C
from millrace.llm.pretokens import pretoken_spans

#: Pre-tokens whose ids a worker keeps; when they are more, those that came back stay.
CACHE_ENTRIES = 250_000
#: Bytes that a worker looks at together; some 60 times as many are in use meanwhile.
STEP = 1 << 19
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the others count up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and token bytes of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            js = json.load(f)
        ids = js["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = [ids[s] for s in symbols]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(js["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        of_symbol = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in js.get("added_tokens", ())}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(of_symbol[s] for s in token) if all(s in of_symbol for s in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()


def merge(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one pre-token.

    Leaf i of the tree holds ``rank * n + i`` for the pair that begins at symbol i, so that the
    root is the leftmost pair of the lowest rank. A merge changes at most three leaves.
    """
    ids = [vocabulary.byte_ids[b] for b in piece]
    n = len(ids)
    if n < 2:
        return ids
    merges = vocabulary.merges
    none = 1 << 62
    size = 1 << (n - 2).bit_length()
    tree = [none] * (2 * size)
    for i in range(n - 1):
        got = merges.get(ids[i] << 32 | ids[i + 1])
        if got is not None:
            tree[size + i] = got[0] * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] < none:
        i = tree[1] % n
        j = after[i]
        ids[i] = merges[ids[i] << 32 | ids[j]][1]
        ids[j] = -1
        after[i] = end = after[j]
        if j < n - 1 or end < n:
            put(j, none) if j < size else None
        if end < n:
            before[end] = i
            got = merges.get(ids[i] << 32 | ids[end])
            put(i, none if got is None else got[0] * n + i)
        else:
            put(i, none)
        left = before[i]
        if left >= 0:
            got = merges.get(ids[left] << 32 | ids[i])
            put(left, none if got is None else got[0] * n + left)
    return [x for x in ids if x >= 0]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that stand for all distinct contents, and for each span which of them it equals."""
    _, where, back = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if C.same_spans(data, starts, ends, where[back]):
        return where, back
    of: dict[bytes, int] = {}  # two contents of one hash
    back = np.array([of.setdefault(data[s:e].tobytes(), len(of)) for s, e in zip(starts.tolist(), ends.tolist())])
    return np.unique(back, return_index=True)[1], back


class Encoder:
    """Encodes batches of texts; ``pieces_ids`` gives the ids of pre-tokens that are not in the cache.

    The cache's keys are the pre-tokens' bytes. Within a step, pre-tokens are brought together by a
    hash and then compared byte for byte with the one that stands for them.
    """

    def __init__(self, special: dict[str, int], pieces_ids: Callable[[list[bytes]], list[list[int]]], entries: int = CACHE_ENTRIES) -> None:
        self.special = {k.encode(): v for k, v in special.items()}
        self.pieces_ids = pieces_ids
        self.entries = entries
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.seen = np.zeros(1 << 12, np.int64)  # steps that had the pre-token
        self.pool = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _add(self, pieces: list[bytes]) -> None:
        found = self.pieces_ids(pieces)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))
        n = len(self.slot)
        while n + len(pieces) > len(self.begin):
            self.begin, self.count, self.seen = (np.resize(x, 2 * len(x)) for x in (self.begin, self.count, self.seen))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(pieces)] = counts
        self.seen[n : n + len(pieces)] = 0
        self.used += len(flat)
        self.slot.update(zip(pieces, range(n, n + len(pieces))))

    def _shrink(self) -> None:
        """Keep the pre-tokens of more than one step, at most half of what may be kept."""
        n = len(self.slot)
        seen = self.seen[:n]
        keep = np.flatnonzero(seen > 1)
        if len(keep) > self.entries // 2:
            keep = np.argsort(-seen, kind="stable")[: self.entries // 2]
        pieces = list(self.slot)  # in the order of their slots
        keys = [pieces[i] for i in keep.tolist()]
        counts, seen = self.count[keep], seen[keep] // 2
        ends = np.cumsum(counts)
        pool = self.pool[np.repeat(self.begin[keep] - (ends - counts), counts) + np.arange(int(counts.sum()))]
        self.clear()
        while max(len(keys), 1) > len(self.begin):
            self.begin, self.count, self.seen = (np.resize(x, 2 * len(x)) for x in (self.begin, self.count, self.seen))
        self.slot = dict(zip(keys, range(len(keys))))
        self.begin[: len(keys)], self.count[: len(keys)], self.seen[: len(keys)] = ends - counts, counts, seen
        self.pool, self.used = np.concatenate([pool, np.zeros(1 << 14, np.uint32)]), len(pool)

    def _scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first = pretoken_spans(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        where, back = _distinct(data, starts, ends)
        if len(self.slot) + len(where) > self.entries:
            self._shrink()
        raw = data.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
        slots = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            self._add([keys[i] for i in new.tolist()])
            slots[new] = np.arange(len(self.slot) - len(new), len(self.slot))
        self.seen[slots] += 1
        slots = slots[back]
        counts = self.count[slots]
        ids = self.pool[np.repeat(self.begin[slots] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[first])

    def _with_special(self, raw: bytes) -> np.ndarray:
        """A text that holds special strings: they become their ids, and what lies between is encoded apart."""
        parts: list[bytes | int] = [raw]
        for token, i in self.special.items():
            cut: list[bytes | int] = []
            for p in parts:
                if isinstance(p, int):
                    cut.append(p)
                    continue
                for k, x in enumerate(p.split(token)):
                    cut += [i, x] if k else [x]
            parts = cut
        out = []
        for p in parts:
            if isinstance(p, int):
                out.append(np.array([p], np.uint32))
            elif p:
                out.append(self._scan(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row range, ids of these rows end to end, ids in each row."""
        data, offsets = C.bytes_of(column)
        for i, j in C.steps(offsets, STEP):
            part = data[offsets[i] : offsets[j]]
            off = offsets[i : j + 1] - offsets[i]
            raw = part.tobytes()
            if any(s in raw for s in self.special):
                rows = [self._with_special(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield i, j, np.concatenate(rows), np.fromiter(map(len, rows), np.int64, j - i)
            else:
                yield i, j, *self._scan(part, off)


#: Under this name a worker keeps its vocabulary, encoder and decoder.
OPERATOR = "bpe"


def _vocabulary(path: str) -> Vocabulary:
    return C.kept(OPERATOR, f"vocabulary {path}", lambda: Vocabulary(path))


def tree_encoder(path: str) -> Encoder:
    """The worker's encoder; it is kept until the worker gets a task of another operator."""

    def make() -> Encoder:
        v = _vocabulary(path)
        return Encoder(v.special, lambda pieces: [merge(p, v) for p in pieces])

    return C.kept(OPERATOR, f"encoder {path}", make)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in a binary."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path)
        for batch in batches:
            for i, j, ids, counts in encoder.encode(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(counts), C.binary_column(ids.astype("<u4", copy=False), counts)], ["doc_id", "n_tokens", "ids"])

    return C.map_arrow(C.id_and_text(docs), run, "doc_id long, n_tokens long, ids binary", OPERATOR)


class Decoder:
    """Decodes runs of ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids laid end to end, counts[i] of them in row i; bytes that are no UTF-8 become U+FFFD."""
        n = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = self.pool[np.repeat(self.begin[ids] - upto[:-1], n) + np.arange(int(upto[-1]))]
        ends = upto[np.concatenate([[0], np.cumsum(counts)])].tolist()
        text = out.tobytes()
        return [text[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def _decoder(path: str) -> Decoder:
    return C.kept(OPERATOR, f"decoder {path}", lambda: Decoder(_vocabulary(path).token_bytes))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, text)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            raw, offsets = _binary(batch.column("ids"))
            for i, j in C.steps(offsets, STEP):
                texts = decoder.texts(np.frombuffer(raw[offsets[i] : offsets[j]], "<u4"), np.diff(offsets[i : j + 1]) // 4)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(3)] + [pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return C.map_arrow(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, text string", OPERATOR)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of decode(encode(docs)) from one Python worker a task instead of two."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = tree_encoder(path), _decoder(path)
        for batch in batches:
            for i, j, ids, counts in encoder.encode(batch.column("text")):
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(counts), C.binary_column(ids.astype("<u4", copy=False), counts), pa.array(decoder.texts(ids, counts), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "text"])

    return C.map_arrow(C.id_and_text(docs), run, "doc_id long, n_tokens long, ids binary, text string", OPERATOR)


def _binary(column) -> tuple[bytes, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (memoryview(data)[off[0] : off[-1]] if data is not None else b""), off - off[0]
