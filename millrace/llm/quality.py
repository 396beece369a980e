"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line that is not blank is labelled good or bad. A line's evidence is a weight for each of
its features and for the same features of the line before and after; neighbouring labels have
weights of their own. Forward-backward gives each line's probability of being good, and the
document's quality is their mean weighted by length, turned into a score by a logistic curve.

Learning takes a bounded sample: about ``SAMPLE`` labelled documents of each label, by a hash of
the id (rows that repeat an id are in it all or none). Only documents are labelled, so lines start with their document's label; then, within
documents labelled bad, lines that the field finds good take that label and it is fitted again.
Scoring is map-only over whole texts; a text's lines stay together, and memory is bounded by a
batch step (or one text).

Defined cases: null, empty and blank texts have no line; their score is the curve's at quality
0. Repeated labels of a document count once; rows of a label table with nulls or another label than
0 and 1 are not used; documents with a null id can be scored but have no label. With one label or
none to learn from, every score is the share of good labels (0.5 without any). Equal texts have equal
scores; a very long text or line is scored whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

SAMPLE = 5000
STEPS, RATE, DECAY = 120, 0.1, 1e-4
BINS = 10
FEATURES = 12

_UPPER, _DIGIT, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_MARK[0x21:0x7F] = True
_MARK &= ~(_DIGIT | _LETTER)
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[list(b".,;:?)\"'")] = True
_EDGES = np.array([0.0, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.9])


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of each line's features, the line's length in bytes, and each text's first line."""
    is_line = np.ones(256, bool)
    is_line[0x0A] = False
    ls, le, _ = C.word_spans(data, offsets, is_line)
    s, e, _ = C.word_spans(data, offsets, C.SPACED)
    line = np.searchsorted(ls, s, "right") - 1
    words = np.bincount(line, minlength=len(ls))
    some = words > 0  # not blank
    ls, le = ls[some], le[some]
    first = np.searchsorted(ls, offsets)
    n = len(ls)
    if n == 0:
        return np.zeros((0, FEATURES), np.uint8), np.zeros(0, np.int64), first
    line = (np.cumsum(some) - 1)[line]
    words = words[some]
    size = le - ls

    def inside(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[le] - upto[ls]

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[mask], minlength=n)

    letters, h = inside(_LETTER[data]), C.span_hashes(data, s, e)
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    tail = data[e - 1]
    has_letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    share = lambda a, b: np.searchsorted(_EDGES, a / np.maximum(b, 1), "left")
    out = np.empty((n, FEATURES), np.uint8)
    out[:, 0] = np.minimum(np.log2(size), BINS - 1)
    out[:, 1] = np.minimum(np.log2(words + 1), BINS - 1)
    out[:, 2] = share(inside(_UPPER[data]), letters)
    out[:, 3] = share(inside(_MARK[data]), size)
    out[:, 4] = share(inside(_DIGIT[data]), size)
    out[:, 5] = share(words - distinct, words)
    out[:, 6] = share(per_word(again), words)
    out[:, 7] = share(per_word(_MARK[tail] & ~_PLAIN_END[tail]), words)
    out[:, 8] = share(per_word(tail == 0x21), words)
    out[:, 9] = np.minimum(letters / words / 1.5, BINS - 1)
    out[:, 10] = share(per_word(has_letter[e] == has_letter[s]), words)
    out[:, 11] = _PLAIN_END[data[le - 1]] + 2 * (data[le - 1] == 0x21)
    return out, size, first


class Field:
    """Weights of the field: evidence for good by place (before, own, after), feature and bin; labels in turn; the curve."""

    def __init__(self) -> None:
        self.weight = np.zeros((3, FEATURES, BINS))
        self.bias = np.zeros(1)
        self.turn = np.zeros((2, 2))
        self.curve = (0.0, 0.0)

    def evidence(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(bins)
        own = self.weight[:, np.arange(FEATURES), bins].sum(axis=2)  # place x line
        out = own[1] + self.bias[0]
        head, last = np.zeros(n, bool), np.zeros(n, bool)
        head[first[:-1][first[:-1] < n]] = True
        last[first[1:][first[1:] > 0] - 1] = True
        before, after = np.roll(own[0], 1), np.roll(own[2], -1)
        return out + np.where(head, 0, before) + np.where(last, 0, after)

    def marginals(self, evidence: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's probability of good, expected label pairs (over all texts), log-normaliser of each text."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        n, begin = n[order], first[:-1][order]
        turn = np.exp(self.turn)
        good = np.exp(np.clip(evidence, -30, 30))
        forward = np.zeros((len(evidence), 2))
        z = np.zeros(len(n))
        most = int(n[0]) if len(n) else 0
        active = [int(np.searchsorted(-n, -t, "left")) for t in range(most)]  # texts with more than t lines
        state = np.ones((0, 2))
        for t in range(most):
            at = begin[: active[t]] + t
            state = (state[: active[t]] @ turn if t else np.ones((active[t], 2))) * np.stack([np.ones(len(at)), good[at]], 1)
            total = state.sum(axis=1, keepdims=True)
            state = state / total
            z[: active[t]] += np.log(total[:, 0])
            forward[at] = state
        out = np.zeros(len(evidence))
        pairs = np.zeros((2, 2))
        back = np.ones((0, 2))
        for t in range(most - 1, -1, -1):
            at = begin[: active[t]] + t
            if t + 1 < most and active[t + 1]:
                k = active[t + 1]
                nxt = begin[:k] + t + 1
                into = back * np.stack([np.ones(k), good[nxt]], 1)
                joint = forward[at[:k]][:, :, None] * turn * into[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                new = np.ones((len(at), 2))
                new[:k] = into @ turn.T
                back = new / new.sum(axis=1, keepdims=True)
            else:
                back = np.ones((len(at), 2))
            both = forward[at] * back
            out[at] = both[:, 1] / both.sum(axis=1)
        logs = np.zeros(len(n))
        logs[order] = z
        return out, pairs, logs

    def quality(self, bins: np.ndarray, size: np.ndarray, first: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """Mean probability of good of each text's lines, weighted by length; 0 without lines. ``p`` has the lines' own, if known."""
        if p is None:
            p, _, _ = self.marginals(self.evidence(bins, first), first)
        upto = np.concatenate([[0], np.cumsum(p * size)])
        total = np.concatenate([[0], np.cumsum(size)])
        return (upto[first[1:]] - upto[first[:-1]]) / np.maximum(total[first[1:]] - total[first[:-1]], 1)

    def score(self, quality: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * _logit(quality) + b)))

    def fit(self, bins: np.ndarray, first: np.ndarray, label: np.ndarray, of_line: np.ndarray) -> None:
        """Maximise the likelihood of the lines' labels (Adam); ``of_line`` weighs each line."""
        head, last = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
        head[first[:-1][np.diff(first) > 0]] = True
        last[first[1:][np.diff(first) > 0] - 1] = True
        flat = (np.arange(FEATURES) * BINS + bins).astype(np.int64)
        seen = np.zeros((2, 2))
        joined = np.flatnonzero(~head)
        np.add.at(seen, (label[joined - 1], label[joined]), 1)
        slots = [self.weight, self.bias, self.turn]
        first_moment, second_moment = [np.zeros_like(x) for x in slots], [np.zeros_like(x) for x in slots]
        total = len(bins)
        for step in range(1, STEPS + 1):
            p, pairs, _ = self.marginals(self.evidence(bins, first), first)
            miss = (label - p) * of_line
            grads = [np.zeros_like(self.weight), np.array([miss.sum()]), seen - pairs]
            for place, off in ((0, np.where(last, 0, np.roll(miss, -1))), (1, miss), (2, np.where(head, 0, np.roll(miss, 1)))):
                grads[0][place] = np.bincount(flat.ravel(), np.repeat(off, FEATURES), FEATURES * BINS).reshape(FEATURES, BINS)
            for x, g, m, v in zip(slots, grads, first_moment, second_moment):
                g = g / total - DECAY * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            np.clip(self.turn, -3, 3, out=self.turn)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton's method, a little regularised."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (y - p) * x).sum() - 1e-2 * a, (w * (y - p)).sum()])
        k = w * p * (1 - p)
        hess = np.array([[(k * x * x).sum() + 1e-2, (k * x).sum()], [(k * x).sum(), k.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> Field:
    """A field from documents (doc_id, text) and labels (doc_id, quality); ``learn`` limits the labels by their doc_id."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    rows = rows.where(F.lit(True) if learn is None else learn)
    counts = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    field = Field()
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        p = good / (good + bad) if good + bad else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        field.curve = (0.0, float(np.log(p / (1 - p))))
        return field
    share = F.when(F.col("quality") == 1, -(-1_000_000 * sample // good)).otherwise(-(-1_000_000 * sample // bad))
    picked = C.bounded_broadcast(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share))  # about 2 * sample rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.bytes_of(batch.column("text"))
            for i, j in C.steps(offsets):
                bins, size, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(i, j - i), C.binary_column(bins.ravel(), n * FEATURES), C.binary_column(size.astype("<i4"), n)], ["quality", "bins", "size"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select("quality", "text")
    got = C.map_arrow(texts, features, "quality int, bins binary, size binary").toArrow()
    y = got.column("quality").to_numpy().astype(np.int64)
    bins = [np.frombuffer(b, np.uint8).reshape(-1, FEATURES) for b in got.column("bins").to_pylist()]
    size = np.concatenate([np.frombuffer(b, "<i4") for b in got.column("size").to_pylist()]).astype(np.int64)
    n = np.array([len(b) for b in bins])
    first = np.concatenate([[0], np.cumsum(n)])
    bins = np.concatenate(bins)
    if not len(bins):
        p = good / (good + bad)
        field.curve = (0.0, float(np.log(p / (1 - p))))
        return field
    of = np.repeat(np.arange(len(y)), n)
    even = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    weight = even[of] / np.maximum(n, 1)[of]
    weight *= len(weight) / weight.sum()
    label = y[of]
    for _ in range(2):
        field.fit(bins, first, label, weight)
        # the lines alone, without their neighbours' labels, say which lines of bad documents are good
        alone = field.evidence(bins, first)
        worst = np.full(len(y), np.inf)
        np.minimum.at(worst, of, alone)
        label = np.where(y[of] == 1, 1, ((alone > 0) & (alone > worst[of])).astype(np.int64))
    weighted = np.where(y == 1, good / max(1, (y == 1).sum()), bad / max(1, (y == 0).sum()))
    field.curve = _curve(_logit(field.quality(bins, size, first)), y, weighted * len(y) / weighted.sum())
    return field


def rate(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_lines, n_good, quality, score, lines) of each row.

    ``lines`` has, for every line that is not blank and in order, the probability that it is good;
    ``n_good`` counts those labelled good, which are the ones above 0.5.
    """
    known = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Field = known.value
        for batch in batches:
            data, offsets = C.bytes_of(batch.column("text"))
            for i, j in C.steps(offsets):
                bins, size, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p, _, _ = f.marginals(f.evidence(bins, first), first)
                q = f.quality(bins, size, first, p)
                good = np.concatenate([[0], np.cumsum(p > 0.5)])[first]
                lines = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(p.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(np.diff(good)), pa.array(q), pa.array(f.score(q)), lines], ["doc_id", "n_lines", "n_good", "quality", "score", "lines"])

    return C.map_arrow(C.id_and_text(docs), run, "doc_id long, n_lines long, n_good long, quality double, score double, lines array<float>")
