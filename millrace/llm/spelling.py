"""Spelling variants: words one edit apart, by an index of variable-length grams.

The grams of a word: from every place the shortest text of two characters or more that is no frequent
gram of the dictionary, at most LONGEST long. So frequent beginnings are read on and lists stay
short. The dictionary holds the grams of each length that have more than a share of all places, so its
size is bounded whatever the words; it grows by one character a level.

An edit affects the grams whose characters it touches (with the end of the word, for a gram that was
cut short by it). All others are in both words: those before the edit at the same place from the start,
those after it at the same place from the end. A word of SHORTEST characters has more grams than one
edit affects. So for every edit there is a rarest unaffected gram, it is the same for both words, and a
word needs an entry for that one alone: a few entries a word. As all that is before (or after) an
unaffected gram is equal too, lists are cut by that text.

A gram that stays frequent at full length would have a long list. There the entry also names the text
without the edited character (of the longer word's edit, the shorter word itself), so a list holds words
that differ in one place and its length depends on the alphabet, not on the number of words. Entries
that meet in a list are verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

SHORTEST = 7
#: A gram's least length, and the most; LONGEST + LEAST must not exceed SHORTEST.
LEAST, LONGEST = 2, 5
#: A gram is frequent if it has more than one in SHARE of all places (and more than FEW): under SHARE grams of each length are.
SHARE, FEW = 1 << 18, 8
#: Letters of a word that its index entries carry.
LONG = 64
#: Places of words that one vectorised step looks at.
CELLS = 1 << 18
#: A-Z lower-cased, a-z and U+00C0 to U+00FF are letters.
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ODD = 0x9FB21C651E98DF25
_BACK = pow(_ODD, -1, 1 << 64)
_NONE = np.iinfo(np.int64).max


def occurrences(docs: DataFrame, shortest: int = SHORTEST, every: int = 31) -> DataFrame:
    """(word, n): words of ``shortest`` letters or more with how often they occur, each occurrence changed by its own draw.

    The draw of a run is the crc32 of its document's id (nothing for none) and itself; where ``every``
    divides it, the letter at that place, modulo its length, is left out.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(LETTER + f"{{{shortest},}}"), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    drawn = runs.select(run.alias("run"), F.crc32(F.concat("doc_id", F.lit(":"), run).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, less).otherwise(F.col("run"))
    return drawn.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter, and offsets: of the two bytes of a letter beyond ASCII the first is always the same and goes."""
    data, offsets = C.bytes_of(column)
    keep = data != 0xC3
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def level_grams(words: DataFrame, size: int, known: np.ndarray) -> DataFrame:
    """(gram, n): grams of ``size`` whose beginning is frequent (``known``, sorted; all where ``size`` is the least), counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = letters(batch.column(0))
            ends = np.repeat(offsets[1:], np.diff(offsets))
            at = np.flatnonzero(ends - np.arange(len(codes)) >= size)
            if size > LEAST:
                at = at[_in(_gram(codes, at, size - 1), known)]
            grams, n = np.unique(_gram(codes, at, size), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64))], ["gram", "n"])

    return C.map_arrow(words.select("word"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _gram(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The letters from each place as one number; the first byte is the length."""
    out = np.full(len(at), size, np.int64)
    for j in range(size):
        out = out << 8 | codes[at + j]
    return out


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(values.shape, bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def dictionary(words: DataFrame, longest: int = LONGEST, share: int = SHARE, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """The frequent grams, sorted, and their counts: fewer than ``share`` of each length."""
    total = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    least = max(few, total // share)
    grams, counts, last = [], [], np.zeros(0, np.int64)
    for size in range(LEAST, longest + 1):
        if size > LEAST and not len(last):
            break
        rows = level_grams(words, size, last).where(F.col("n") > least).toArrow()
        last, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(last)
        last = last[order]
        grams.append(last)
        counts.append(n[order])
    return np.concatenate(grams), np.concatenate(counts)  # lengths ascend, and the length is the first byte


def entries(codes: np.ndarray, offsets: np.ndarray, grams: np.ndarray, counts: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the index entries of words that are laid end to end."""
    sizes = np.diff(offsets)
    rows, keys = [], []
    order = np.argsort(sizes, kind="stable")
    by_size = sizes[order]
    i = 0
    while i < len(order):  # words of like length, CELLS places at a time
        j = int(np.searchsorted(by_size, by_size[i] + max(4, by_size[i] // 4), "right"))
        j = min(j, i + max(1, CELLS // int(by_size[j - 1] + 8)))
        which = order[i:j]
        r, k = _entries(codes, offsets[which], sizes[which], grams, counts, longest)
        rows.append(which[r])
        keys.append(k)
        i = j
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *keys])


def _entries(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, grams: np.ndarray, counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    n, most = len(sizes), int(sizes.max())
    place = np.arange(most)
    there = place < sizes[:, None]
    c = np.zeros((n, most + longest), np.int64)
    c[:, :most][there] = codes[(starts[:, None] + place)[there]]

    # the gram from every place, the last place that it depends on, and its count where it is frequent
    gram = np.zeros((n, most), np.int64)
    last = np.zeros((n, most), np.int64)
    length = np.zeros((n, most), np.int64)
    seen = np.zeros((n, most), np.int64)
    code, live = np.zeros((n, most), np.int64), there.copy()
    for size in range(1, longest + 1):
        code = code << 8 | c[:, size - 1 : size - 1 + most]
        fits = place + size <= sizes[:, None]
        ended = live & ~fits  # it would be read on, but for the word's end
        if size > LEAST:
            np.copyto(last, np.broadcast_to(sizes[:, None], last.shape), where=ended)
        live = live & fits
        if size < LEAST:
            continue
        tagged = code | size << 8 * size
        np.copyto(gram, tagged, where=live)
        np.copyto(last, np.broadcast_to(place + size - 1, last.shape), where=live)
        np.copyto(length, size, where=live)
        found = _in(tagged[live], grams)
        at = np.flatnonzero(live)
        times = np.zeros(len(at), np.int64)
        times[found] = counts[np.searchsorted(grams, tagged[live][found])]
        seen.flat[at] = times
        live.flat[at[~found]] = False

    # a rank for every gram: rare ones first, equal ones by place
    real = length > 0
    at = np.flatnonzero(real)
    column = at % most
    by = np.lexsort((column, C.mix(gram.flat[at].view(np.uint64)), seen.flat[at]))
    rank = np.full((n, most + 2), _NONE)
    rank[:, :most].flat[at] = 0
    flat = np.empty(len(at), np.int64)
    flat[by] = np.arange(len(at))
    rank[np.nonzero(real)] = flat
    column_of = column[by]
    before = np.full((n, most + 3), _NONE)
    row_of = at // most
    np.minimum.at(before, (row_of, last.flat[at] + 1), flat)
    before = np.minimum.accumulate(before, axis=1)  # [i]: grams that end their reading before place i
    after = np.minimum.accumulate(rank[:, ::-1], axis=1)[:, ::-1]  # [i]: grams from place i on

    odd, back = _powers(most + longest + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros((n, most + 1), np.uint64)
        np.cumsum((c[:, :most].astype(np.uint64)) * odd[:most], axis=1, out=prefix[:, 1:])
    whole = prefix[np.arange(n), sizes]

    rows, keys = [], []
    for gap in (False, True):  # a character of the word is left out or replaced; one is put in before a place
        slot = np.arange(most + 1)
        best = np.minimum(before[:, : most + 1], after[:, slot if gap else slot + 1])
        valid = slot < sizes[:, None] + gap
        r, i = np.nonzero(valid & (best < _NONE))
        p = column_of[best[r, i]]
        right = p >= i + (not gap)
        end = p + length[r, p]
        with np.errstate(over="ignore"):
            context = np.where(right, (whole[r] - prefix[r, p]) * back[p], prefix[r, end])
            reach = np.where(right, sizes[r] - p, end).astype(np.uint64)
            context = C.mix(C.mix(context) + reach * np.uint64(2) + right.astype(np.uint64))
            rest = whole[r] if gap else prefix[r, i] + (whole[r] - prefix[r, np.minimum(i + 1, sizes[r])]) * back[1]
            crowded = seen[r, p] > 0
            key = np.where(crowded, C.mix(context ^ C.mix(rest + np.uint64(1))), context)
        rows.append(r)
        keys.append(key.view(np.int64))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[first], keys[first]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_ODD, _BACK):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


def index(words: DataFrame, grams: np.ndarray, counts: np.ndarray, longest: int = LONGEST, carried: tuple[str, ...] = ("word", "n")) -> DataFrame:
    """(key, carried...): the index entries of words, each with these columns of its row; the dictionary is bounded, so every task may hold it."""
    held = words.sparkSession.sparkContext.broadcast((grams, counts))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.select(*carried).schema.fields)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = letters(batch.column("word"))
            for i, j in C.steps(offsets):
                rows, keys = entries(codes, offsets[i : j + 1], *held.value, longest)
                rows = pa.array(rows + i)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c).take(rows) for c in carried)], ["key", *carried])

    return C.map_arrow(words.select("word", *(c for c in carried if c != "word")), enter, f"key long, {schema}")


def near_pairs(words: DataFrame, shortest: int = SHORTEST, share: int = SHARE, few: int = FEW) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of distinct (word, n) that one edit turns into each other, once each.

    Words of up to LONG letters go into the index as they are. A longer word has as many entries as
    letters at worst, so it goes by a number, and its text meets the pairs that were found; words of about
    LONG letters are in both indexes.
    """
    longest = min(LONGEST, shortest - LEAST)
    if longest < LEAST:
        raise ValueError(f"words of fewer than {2 * LEAST} letters have no gram that every edit leaves")
    known = dictionary(words, longest, share, few)
    size = F.length("word")
    found = C.materialise(index(words.where(size <= LONG + 1), *known, longest), "grams")
    a, b = (found.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    pairs = a.join(b, "key").where(near).select("a", "n_a", "b", "n_b")

    long = C.materialise(words.where(size >= LONG).select("word", "n", size.alias("size"), F.monotonically_increasing_id().alias("id")), "long")
    if not long.isEmpty():
        found = C.materialise(index(long, *known, longest, ("id", "size")), "grams")
        a, b = (found.select("key", F.col("id").alias(f"id_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
        met = a.join(b, "key").where("id_a < id_b and abs(size_a - size_b) <= 1").select("id_a", "id_b").distinct()
        for x in "xy":
            met = met.join(long.select(F.col("id").alias("id_a" if x == "x" else "id_b"), F.col("word").alias(x), F.col("n").alias(f"n_{x}")), "id_a" if x == "x" else "id_b")
        low = F.col("x") < F.col("y")
        pick = lambda p, q: F.when(low, F.col(p)).otherwise(F.col(q))
        met = met.where(F.levenshtein("x", "y", 1) == 1)
        pairs = pairs.union(met.select(pick("x", "y").alias("a"), pick("n_x", "n_y").alias("n_a"), pick("y", "x").alias("b"), pick("n_y", "n_x").alias("n_b")))
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where forms lead from each word. Every round doubles the steps; forms must not lead round in circles."""
    state = C.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = C.materialise(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(words: DataFrame, times: int = 10, shortest: int = SHORTEST, share: int = SHARE, few: int = FEW) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct (word, n) of ``shortest`` letters or more.

    A word's form is its near word of largest n (ties: the smallest), if that is ``times`` its own n or
    more; with ``times`` over 1 forms can't lead round in circles. An empty table gives an empty one.
    """
    pairs = near_pairs(words, shortest, share, few)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.union(pairs.select("b", "n_b", "a", "n_a"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    per = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = C.materialise(words.select("word", "n").join(per, "word", "left"), "forms")
    formed = F.col("best.near_n") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(formed, F.col(f"best.{c}")).alias(x) for c, x in (("near", "form"), ("near_n", "form_n"))])
    leads = roots(known.where("form is not null"))
    return known.join(leads, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, times: int = 10) -> DataFrame:
    """``variants`` of the words that occur ``least`` times or more in ``docs`` (doc_id, text).

    Texts are read whole, and words may be of any length. A null or empty text has no words; rows that
    repeat count each; other columns are left alone.
    """
    words = C.materialise(occurrences(docs, shortest).where(F.col("n") >= least), "words")
    return variants(words, times, shortest)
