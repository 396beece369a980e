"""Spelling variants, source mixes and filter audits against brute force, with odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import filter_audit, language_id, mixing, queries, spelling
from tests.llm.test_edge_cases import LONG, ODD, make

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# --- spelling -----------------------------------------------------------------------------------


def words_of(rows, shortest=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def variants_of(words, times=10):
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            near[w] |= less[i, v] - {w}
            if v in words:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= times * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def test_op11_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = variants_of(words_of(rows))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling_variants(spark, DIR).collect()}
    assert got == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("share,few", [(1 << 18, 8), (64, 8), (10, 0), (1 << 18, 10**6)])
def test_dense_words_whatever_the_dictionary(spark, share, few):
    """Few letters, so that most grams are frequent, or, with other bounds, none is."""
    r = random.Random(1)
    words = {}
    while len(words) < 2500:
        words["".join(r.choice("abé") for _ in range(r.randint(7, 10)))] = r.randint(2, 3000)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(df, share=share, few=few).collect()}
    assert got == variants_of(words)
    assert len({v[1] for v in got.values()} - set()) < len(got)


def test_long_words_and_other_lengths(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdefgh", k=40_000))
    words = {long: 100, long[:-1]: 10, long[:20_000] + "z" + long[20_000:]: 1, "x" * 300: 5, "x" * 301: 50, "abcd": 3, "abcde": 30, "ÿÀ×÷abc": 2, "ÿÀ×÷abd": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(df, shortest=4).collect()}
    assert got == variants_of(words)
    with pytest.raises(ValueError):
        spelling.near_pairs(df, shortest=3)


def test_every_edit_leaves_a_common_entry():
    r = random.Random(3)
    words = ["".join(r.choices("abcd", k=r.randint(7, 12))) for _ in range(400)]
    grams = np.array(sorted({spelling._gram(np.frombuffer(w.encode(), np.uint8), np.array([0]), n)[0] for w in words for n in (2, 3, 4)}))
    near = [(w, v) for w in words for i in range(len(w) + 1) for v in (w[:i] + "b" + w[i:], w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :]) if v != w and len(v) >= 7]
    every = sorted({x for p in near for x in p})
    codes, offsets = spelling.letters(pa.array(every))
    for known in (grams, grams[:0]):
        rows, keys = spelling.entries(codes, offsets, known, np.full(len(known), 9))
        of = defaultdict(set)
        for row, key in zip(rows.tolist(), keys.tolist()):
            of[every[row]].add(key)
        assert all(of[a] & of[b] for a, b in near)


def test_spelling_of_odd_rows(spark):
    texts = [*ODD, "Abcdefgh abcdefgh ABCDEFGI", "abcdefgi", None]
    docs = make(spark, texts, [*range(len(texts) - 1), None]).union(make(spark, ["abcdefgh abcdefgi"] * 2, [None, None]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    assert got == variants_of(words_of(rows)) and "abcdefgh" in got
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert LONG in texts


# --- mixes ---------------------------------------------------------------------------------------


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again what is above a limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, out = set(names), float(sum(sizes.values())), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / total > most * sizes[s] + 1e-9] if open_ else []
        if not over:
            break
        for s in over:
            out[s] = float(most * sizes[s])
            open_.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out | {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}


def mixed(docs):
    return mixing.mix(docs).collect()


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_its_targets(spark, seed):
    r = random.Random(seed)
    sources = [None, "", "a", "b", "é", "z", "zz"][: r.randint(1, 7)]
    rows = [(i, "w " * int(r.paretovariate(0.7) % 400), r.choices(sources, weights=[2**k for k in range(len(sources))])[0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(df)
    assert sorted(x.doc_id for x in got) == list(range(300))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(SPACE.findall(t))
    want = shares(sizes)
    of = {i: (s, len(SPACE.findall(t))) for i, t, s in rows}
    taken = Counter()
    for x in got:
        source, size = of[x.doc_id]
        assert (x.size, x.source_size, x.name) == (size, sizes[source], source)
        assert abs(x.target - want[source]) < 1e-6 * (1 + want[source])
        assert 0 <= x.taken <= 3 * size
        taken[source] += x.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) < 1
    again = {x.doc_id: x.taken for x in mixed(df.repartition(7))}
    assert again == {x.doc_id: x.taken for x in got}


def test_mix_of_odd_rows(spark):
    docs = make(spark, [*ODD, "again", "again"], [*range(len(ODD)), 100, 100]).union(make(spark, ["no id", "no id", "other"], [None] * 3))
    got = mixed(docs)
    assert len(got) == docs.count() and {x.name for x in got} == {None}
    total = sum(x.size for x in got)
    assert sum(x.taken for x in got) == total and all(x.target == x.source_size == total for x in got)
    assert mixed(docs.limit(0)) == []
    empty = mixed(make(spark, ["", None, " "]))
    assert [(x.size, x.target, x.taken) for x in empty] == [(0, 0.0, 0)] * 3


# --- audits ---------------------------------------------------------------------------------------


def audited(rows, labels):
    """STEPS by running every order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, text, part in rows:
        t = text or ""
        w = SPACE.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[part or ""].append((fails, *labels.get(i, (0, 0))))
    out = {}
    for part, docs in parts.items():
        removed = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                removed[f] += len(gone)
                only = sum(x[0][f] and sum(x[0].values()) == 1 for x in docs)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x[0][f] for x in docs) - len(gone), only, sum(x[1] == 1 for x in gone), sum(x[2] == 1 for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order_run(spark):
    r = random.Random(5)
    filler = " ".join(f"w{i}" for i in range(210))
    kinds = ["short", filler, filler + " #", filler.upper(), "a " * 300, "A " * 300 + "|", None, "", LONG, "$ X"]
    rows = [(i if i % 11 else None, r.choice(kinds), r.choice(["p", "q", "", None])) for i in range(120)]
    rows += [(5, rows[5][1], rows[5][2])] * 2  # a row thrice
    labels = {i: (r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 120, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as quality", "2 as mask", "3 as n", "4 as part", "5 as words")
    marks = spark.createDataFrame([(i, *v, 1) for i, v in labels.items()] + [(None, 1, 1, 1)], "doc_id long, quality int, toxic int, n int")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.filter_audit(docs, marks).collect()}
    want = audited(rows, labels)
    assert len(got) == 3 * 600 and got == want
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
    assert filter_audit.filter_audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_fields_do_not_overflow():
    _, packed = filter_audit.outcomes(5)
    most = 2**62
    total = most * packed[31] + (most - 1) * packed[31]
    fields = filter_audit.unpacked(total, 600).reshape(120, 5)
    assert (fields[:, 0] == 2 * most - 1).all() and (fields[:, 1:] == 0).all()


# --- language ID: what there is to learn from ------------------------------------------------------


def test_one_labelled_row_is_learned_from(spark):
    for i in range(12):  # some of these ids are in the quarter that calibrates
        docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog", "en"), (100, "the dog and the cat", None)], "doc_id long, text string, lang string")
        model = language_id.train(docs)
        assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"en"}


def test_a_language_whose_rows_all_calibrate_is_learned(spark):
    from pyspark.sql import functions as F

    held = spark.range(400).where(F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(4)) == 0).select(F.col("id").alias("doc_id"))
    other = spark.range(400, 500).select(F.col("id").alias("doc_id"))
    docs = held.selectExpr("doc_id", "'der hund und die katze sind im haus ' || doc_id as text", "'de' as lang").union(other.selectExpr("doc_id", "'the dog and the cat are in the house ' || doc_id as text", "'en' as lang"))
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert all(r.lang_pred == r.lang for r in got)
