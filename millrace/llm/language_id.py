"""Language ID by interpolated Kneser-Ney character models.

One model of 4-grams per language. All languages share one sorted array of 4-gram hashes, whose
rows hold the log-probability in every language, so that a position is looked up once; shorter
n-grams and back-off weights have arrays of their own for what no language has seen. A text's
language is the one of least cross-entropy per character. The score is the probability that a
held-back part of the training side gives to that margin, and a text is rejected if its
cross-entropy is far above what that part shows for texts of its length.

Texts are lower-cased; every run of other characters than letters counts as one space. Training
reads a bounded sample: about ``SAMPLE`` labelled documents per language, taken by a hash of the
id, which with the length of texts bounds the model. Scoring is map-only over whole texts.

Defined cases: a null text, an empty one or one without letters is ``und`` with score 0 and is
rejected; with no labelled documents every text is ``und``; rows without a language are scored
but not learned from; the language, source and id of a row play no part in its prediction, and equal
texts have equal predictions; of languages with one cross-entropy the first by name is taken; a very
long text or word is read whole; an empty table gives an empty one; columns of any name are kept. A row
without an id is scored, and is on neither side of a division by ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.pretokens import LETTER, char_classes

ORDER = 4
#: Labelled documents per language that the counts are taken from, and that calibration sees.
SAMPLE, CALIBRATION = 2000, 500
UNKNOWN = "und"
#: Bytes of text that are looked up together.
STEP = 1 << 19
#: A text is rejected beyond this many standard errors, and this many nats, above calibration's mean.
ERRORS, NATS = 8.0, 1.0


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (at most 0xFFFF) of the prepared texts end to end, each with ORDER - 1 spaces before it, and each text's first place."""
    pad = " " * (ORDER - 1)
    lowered = [pad + t.lower() for t in texts]
    joined = "".join(lowered)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    letter = char_classes()[c] == LETTER
    c = np.where(letter, np.minimum(c, 0xFFFF), 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    keep[0] = True
    for k in range(ORDER - 1):  # the padding stays
        keep[first[:-1] + k] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], at[first]


def grams(c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of each text, and each text's first (a text has as many as characters)."""
    if len(c) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    key = c[: len(c) - ORDER + 1].copy()
    for k in range(1, ORDER):
        key = key << np.uint64(16) | c[k : len(c) - ORDER + 1 + k]
    inside = np.ones(len(key), bool)
    for k in range(1, ORDER):  # those that begin at the end of a text and go on in the next
        cut = first[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(key))]] = False
    at = np.concatenate([[0], np.cumsum(inside)])
    return key[inside], at[np.minimum(first, len(key))]


class HashArray:
    """A sorted array of hashes with the place where each value of the leading bits begins."""

    def __init__(self, keys: np.ndarray) -> None:
        h = C.mix(keys)
        self.order = np.argsort(h)
        self.hash = np.append(h[self.order], np.uint64(2**64 - 1))
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.jump = np.searchsorted(self.hash[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the sorted array, -1 where they are not."""
        h = C.mix(keys)
        at = self.jump[(h >> self.shift).astype(np.int64)]
        got = self.hash[at]
        out = np.where(got == h, at, -1)
        left = np.flatnonzero(got < h)
        at = at[left]
        while len(left):
            at = at + 1
            got = self.hash[at]
            want = h[left]
            hit = got == want
            out[left[hit]] = at[hit]
            more = got < want
            left, at = left[more], at[more]
        last = len(self.hash) - 1
        out[out == last] = -1
        return out


class KneserNey:
    """Interpolated Kneser-Ney models of several languages over shared hash arrays."""

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tables: for each language its distinct packed 4-grams and their counts."""
        self.languages = languages
        n_lang = len(languages)
        mask = [(np.uint64(1) << np.uint64(16 * k)) - np.uint64(1) if k < 4 else np.uint64(2**64 - 1) for k in range(ORDER + 1)]
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for keys, n in tables:
            own = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * (ORDER + 1)
            own[ORDER] = (keys, n.astype(np.int64))
            for k in range(ORDER - 1, 0, -1):  # how many different characters stand before an n-gram
                own[k] = np.unique(own[k + 1][0] & mask[k], return_counts=True)
            counts.append(own)
        self.arrays: list[HashArray | None] = [None] * (ORDER + 1)
        self.log: list[np.ndarray] = [np.zeros((1, n_lang), np.float32)] * (ORDER + 1)
        self.contexts: list[HashArray | None] = [None] * (ORDER + 1)
        self.back: list[np.ndarray] = [np.zeros((1, n_lang), np.float32)] * (ORDER + 1)
        alphabet = np.unique(np.concatenate([own[1][0] for own in counts])) if counts else np.zeros(0, np.uint64)
        self.floor = -float(np.log(len(alphabet) + 1))
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([own[k][0] for own in counts]))
            heads = np.unique(keys >> np.uint64(16))
            array, context = HashArray(keys), HashArray(heads)
            prob = np.zeros((len(keys), n_lang))
            back = np.zeros((len(heads), n_lang))
            rest = np.full((len(keys), n_lang), np.exp(self.floor)) if k == 1 else np.exp(self._lookup(keys & mask[k - 1], k - 1))
            for i, own in enumerate(counts):
                got, n = own[k]
                ones, twos = int((n == 1).sum()), int((n == 2).sum())
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
                seen = np.searchsorted(keys, got)
                place = np.searchsorted(heads, got >> np.uint64(16))
                total = np.bincount(place, n, len(heads))
                kinds = np.bincount(place, minlength=len(heads))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                back[:, i] = np.log(weight)
                of_key = np.searchsorted(heads, keys >> np.uint64(16))
                prob[:, i] = weight[of_key] * rest[:, i]
                prob[seen, i] += (n - discount) / total[place]
            self.arrays[k], self.log[k] = array, np.log(prob)[array.order].astype(np.float32)
            self.contexts[k], self.back[k] = context, back[context.order].astype(np.float32)

    def _lookup(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log-probabilities of packed k-grams in every language."""
        array = self.arrays[k]
        at = array.find(keys)
        out = self.log[k][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            gone = keys[miss]
            context = self.contexts[k].find(gone >> np.uint64(16))
            weight = self.back[k][context]
            weight[context < 0] = 0
            if k == 1:
                lower = np.full(weight.shape, self.floor, np.float32)
            else:
                lower = self._lookup(gone & ((np.uint64(1) << np.uint64(16 * (k - 1))) - np.uint64(1)), k - 1)
            out[miss] = weight + lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and its characters."""
        keys, first = grams(*characters(texts))
        n = np.diff(first)
        log = self._lookup(keys, ORDER)
        sums = np.zeros((len(texts), log.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(log.astype(np.float64), first[:-1][some], axis=0)
        return -sums / np.maximum(n, 1)[:, None], n


class Model:
    """Language models with their calibration."""

    def __init__(self, models: KneserNey | None, sharpness: float = 8.0, mean: np.ndarray | None = None, deviation: np.ndarray | None = None) -> None:
        self.models, self.sharpness, self.mean, self.deviation = models, sharpness, mean, deviation

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies and whether each text is rejected."""
        lettered = np.array([next(filter(str.isalpha, t), None) is not None for t in texts], bool)
        if self.models is None:
            zero = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), zero, zero, np.ones(len(texts), bool)
        h, n = self.models.entropies(texts)
        best = h.argmin(axis=1)
        low = h.min(axis=1)
        score = 1 / np.exp(-self.sharpness * (h - low[:, None])).sum(axis=1)
        score[~lettered] = 0
        far = low > self.mean[best] + ERRORS * self.deviation[best] / np.sqrt(np.maximum(n, 1)) + NATS
        names = [self.models.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
        return names, score, np.where(lettered, low, 0), far | ~lettered


def _sampled(docs: DataFrame, part: Column, most: int) -> DataFrame:
    """(lang, text) of about ``most`` labelled rows per language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & part)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1_000_000, -(-1_000_000 * most // n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share).select("lang", "text")


def train(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from labelled rows (doc_id, text, lang) where ``learn`` is true; a quarter of them, by id, calibrates it.

    A language whose rows are all in that quarter is learned from them.
    """
    learn = F.lit(True) if learn is None else learn
    quarter = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(4)) == 0
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    alone = [r.lang for r in labelled.groupBy("lang").agg(F.bool_and(quarter).alias("all")).where("all").collect()]
    held = quarter & ~F.col("lang").isin(alone) if alone else quarter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column("text").filter(pa.array(langs == lang)).to_pylist()
                keys, n = np.unique(grams(*characters(texts))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = C.map_arrow(_sampled(docs, learn & ~held, sample), count, "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    if not languages:
        return Model(None)
    tables = []
    for lang in languages:
        own = table[table["lang"] == lang].sort_values("gram")
        keys, n = own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy()
        order = np.argsort(keys)
        tables.append((keys[order], n[order]))
    return calibrate(KneserNey(languages, tables), _sampled(docs, learn & quarter, CALIBRATION))


def calibrate(models: KneserNey, rows: DataFrame) -> Model:
    """Choose the sharpness of the score by likelihood and measure cross-entropies, on rows that the counts don't have."""
    known = rows.sparkSession.sparkContext.broadcast(models)
    index = {name: i for i, name in enumerate(models.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = known.value.entropies(batch.column("text").to_pylist())
            truth = [index.get(x, -1) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(truth, pa.int32()), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], ["truth", "n", "h"])

    got = C.map_arrow(rows, run, "truth int, n long, h array<double>").where("truth >= 0 and n > 0").toArrow()
    n_lang = len(models.languages)
    mean, deviation = np.full(n_lang, -models.floor), np.ones(n_lang)
    if not got.num_rows:
        return Model(models, 8.0, mean, deviation)
    truth, n, h = got.column("truth").to_numpy(), got.column("n").to_numpy(), np.array(got.column("h").to_pylist())
    gap = h - h.min(axis=1, keepdims=True)
    loss = {a: float((a * gap[np.arange(len(truth)), truth] + np.log(np.exp(-a * gap).sum(axis=1))).mean()) for a in (0.5, 1, 2, 4, 8, 16, 32)}
    right = h.argmin(axis=1) == truth
    for i in range(n_lang):
        own = right & (truth == i)
        if own.sum() >= 2:
            mean[i] = np.average(h[own, i], weights=n[own])
            deviation[i] = np.sqrt((n[own] * (h[own, i] - mean[i]) ** 2).mean())
    return Model(models, min(loss, key=loss.get), mean, deviation)


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with lang_pred, score, entropy and rejected added, under names with ``prefix`` before them.

    Columns of ``docs`` that have one of these names are replaced; a prefix keeps them.
    """
    added = [prefix + c for c in ("lang_pred", "score", "entropy", "rejected")]
    docs = docs.select(*C.quoted([c for c in docs.columns if c not in added]))
    known = docs.sparkSession.sparkContext.broadcast(model)
    names, text = docs.columns, docs.columns.index("text")
    # columns go through Python under plain names, whatever theirs are
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    schema += ", lang_pred string, score double, entropy double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = C.bytes_of(batch.column(text))
            for i, j in C.steps(offsets, STEP):
                part = batch.slice(i, j - i)
                found, score, entropy, rejected = known.value.predict([t or "" for t in part.column(text).to_pylist()])
                columns = [*part.columns, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score", "entropy", "rejected"])

    return C.map_arrow(plain, run, schema).toDF(*names, *added)
