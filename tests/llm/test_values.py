"""Values, not counts, of every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from millrace.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, quality, substring_dedup, token_counts, token_files

SCHEMA = "doc_id long, text string, lang string, did long, rid long, component long, kept boolean, `a.b` string, `__score` double, original string, digest string, row int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmno", k=r.randint(1, 9))) for _ in range(n))


SPAN = words(60, 1)
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t\n "),
    (4, "one"),
    (5, "One"),
    (6, "x" * 300_000),  # a very long word and line
    (7, words(20_000, 2)),  # a very long text of one line
    (8, words(20_000, 2)),
    (9, f"{words(70, 3)}\n{SPAN}\nRead more\n"),
    (10, f"{words(70, 4)}\nRead more\n{SPAN}"),
    (11, f"{SPAN} {words(70, 5)}\nRead more"),
    (12, SPAN),
    (12, SPAN),  # a repeated row
    (12, words(80, 6)),  # another text of the same id
    (13, words(80, 6).upper()),
    (14, "e " * 400),
    (15, "ß é 日本 　🎉 <|endoftext|> it's  two  spaces"),
    (None, SPAN),
    (None, "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 3 else None, 1, 2, 3, False, "dot", 0.5, "o", "d", k) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def values(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").encode().lower().decode()


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x in ROWS]
    want = Counter((i, len(n), struct.pack(f"<{len(n)}I", *n), t.decode(n, skip_special_tokens=False)) for (i, _), n in zip(ROWS, ids))
    for df in (bpe.decode(bpe.encode(docs)), bpe.encode_and_decode(docs), P.encode(spark, docs, "")):
        assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in df.collect()) == want


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    token_files.write(docs, str(tmp_path / "f"))
    got = token_files.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    encoded = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]
    want = Counter((i, zlib.crc32(struct.pack(f"<{len(n)}I", *n))) for i, n in ((i, encoded(x)) for i, x in ROWS))
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in got) == want
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == [None] * ids.count(None) + sorted(i for i in ids if i is not None)


def test_token_counts(docs):
    m = token_counts.model(token_counts.model_path())
    assert values(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == Counter((i, len((t or "").encode()), len(m.encode(t or ""))) for i, t in ROWS)


def test_exact_dedup(spark, docs):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lower(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        left = 1  # of rows of the best id one is kept
        for i in ids:
            keep = i == best and left > 0
            left -= keep
            want[(i, best, len(ids), keep, hashlib.sha256(text.encode()).digest())] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == want
    stay = P.drop_copies(spark, docs, "")
    assert stay.columns == docs.columns
    assert sorted(lower(r.text) for r in stay.collect()) == sorted(groups)
    assert {r["a.b"] for r in stay.collect()} == {"dot"}


def shingles(t):
    w = spaced(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def components(sets):
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_jaccard(spark, docs):
    sets = [shingles(t) for _, t in ROWS]
    label = components(sets)
    smallest = {k: min((ROWS[i][0] for i in range(len(ROWS)) if label[i] == k and ROWS[i][0] is not None), default=None) for k in set(label)}
    want = Counter((ROWS[i][0], len(s), smallest[label[i]] if s else ROWS[i][0]) for i, s in enumerate(sets))
    assert values(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == want
    stay = P.drop_near_copies(spark, docs, "")
    assert stay.columns == docs.columns
    # one row a component, the smallest id with one of its texts
    got = Counter(label[next(k for k, (i, t) in enumerate(ROWS) if (i, t) == (r.doc_id, r.text))] for r in stay.collect())
    assert got == Counter(set(label))
    assert all(r.doc_id == smallest[label[next(k for k, (i, t) in enumerate(ROWS) if (i, t) == (r.doc_id, r.text))]] for r in stay.collect())


def test_substring_dedup(docs):
    first = {}
    for i, t in ROWS:
        w = spaced(t)
        if i is not None:
            for p in range(len(w) - 49):
                key = tuple(w[p : p + 50])
                first[key] = min(i, first.get(key, i))
    want = Counter()
    for i, t in ROWS:
        w = spaced(t)
        gone = set() if i is None else {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        want[(i, len(w), " ".join(x for q, x in enumerate(w) if q not in gone))] += 1
    assert values(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "kept") == want


def test_line_dedup(docs):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(docs).collect())
    # the recurring lines: "Read more" in three documents, SPAN as a line in 9, 10, 12 and the row without an id
    want = Counter()
    for i, t in ROWS:
        lines = t.split("\n") if t else []
        kept = [x for x in lines if x not in ("Read more", SPAN)]
        want[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert got == want


def test_decontaminate(spark, docs, tmp_path):
    items = [(1, SPAN.upper()), (2, "no ID!"), (3, None), (None, "one"), (4, "..."), (5, words(12, 99)), (2, "No, id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    item_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, t in items:
        w = item_words(t) if item is not None else []
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(str(item))
    want, clean = Counter(), []
    for i, t in ROWS:
        w = item_words(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                own = windows.get(tuple(w[p : p + size]))
                if own:
                    hit |= set(range(p, p + size))
                    found |= own
        want[(i, len(w), len(hit), tuple(sorted(found)))] += 1
        clean += [] if hit else [(i, t)]
    got = Counter((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == want
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stay = P.drop_contaminated(spark, docs, str(tmp_path))
    assert stay.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in stay.collect()) == Counter(clean)


def test_language_stage_and_equal_texts(spark, docs):
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    named = language_id.identify(docs, model, prefix="p_")
    assert named.columns == [*docs.columns, "p_lang_pred", "p_score", "p_entropy", "p_rejected"]
    by_text = defaultdict(set)
    for r in named.collect():
        by_text[r.text].add((r.p_lang_pred, r.p_score, r.p_rejected))
        assert r["__score"] == 0.5
        assert (r.p_lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert all(len(v) == 1 for v in by_text.values())
    stay = P.keep_languages(spark, docs, "")
    assert stay.columns == docs.columns and {r["__score"] for r in stay.collect()} == {0.5}
    assert not {1, 2, 3} & {r.doc_id for r in stay.collect()}
    # without anything to learn from nothing is accepted
    assert P.keep_languages(spark, docs.withColumn("lang", docs.lang.substr(1, 0)).where("false"), "").count() == 0


def test_a_tie_of_languages_goes_to_the_first_name():
    import numpy as np

    table = np.unique(language_id.grams(*language_id.characters(["the cat sat on the mat"]))[0], return_counts=True)
    models = language_id.KneserNey(["aa", "zz"], [table, table])
    names, score, _, _ = language_id.Model(models, 8.0, np.ones(2), np.ones(2)).predict(["the cat", "...", ""])
    assert names == ["aa", "und", "und"] and score.tolist() == [0.5, 0, 0]


def test_quality(spark, docs):
    labels = spark.createDataFrame([(4, 1), (4, 1), (9, 1), (10, 0), (11, 0), (12, 2), (13, None), (None, 1)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    by_text = defaultdict(set)
    got = quality.rate(docs, field).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    lines = {i: sum(1 for x in (t or "").split("\n") if x.strip(" \t\r\f\v")) for i, t in ROWS if i is not None and i != 12}
    for r in got:
        assert 0 <= r.score <= 1 and len(r.lines) == r.n_lines and sum(p > 0.5 for p in r.lines) == r.n_good
        if r.doc_id in lines:
            assert r.n_lines == lines[r.doc_id]
            by_text[next(t for i, t in ROWS if i == r.doc_id) or ""].add(r.score)
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_stages_on_an_empty_table(spark, docs, stage, tmp_path):
    spark.createDataFrame([(1, "an item of words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs.where("false"), str(tmp_path))
    assert out.count() == 0
    assert stage is P.encode or out.columns == docs.columns


def test_run_is_the_stages_in_turn(spark, tmp_path):
    """The pipeline against the composition of the stages' brute forces, on texts of one language."""
    base = "the quick brown fox jumps over the lazy dog and then it sleeps under a warm sun while birds sing in old trees near the river bank".split()
    r = random.Random(5)
    sentence = lambda n: " ".join(r.choice(base) for _ in range(n))
    item = " ".join(f"benchmark{i}" for i in range(12))
    rows = [(i, sentence(40)) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper()) for i in range(5)] + [(200 + i, rows[i][1] + " extra") for i in range(10, 15)]
    rows += [(300, f"{sentence(10)} {item} {sentence(10)}"), (301, None), (302, "12 34"), (7, sentence(40)), (303, "")]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    best = {}
    for i, t in left:
        best[lower(t)] = max(i, best.get(lower(t), i))
    left = [(i, t) for i, t in left if best[lower(t)] == i]
    label = components([shingles(t) for _, t in left])
    keep = {k: min(left[i] for i in range(len(left)) if label[i] == k)[0] for k in set(label)}
    left = [x for x, k in zip(left, label) if keep[k] == x[0]]
    left = [(i, t) for i, t in left if item not in t]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.n_tokens) for r in got) == Counter((i, x, len(t.encode(x, add_special_tokens=False).ids)) for i, x in left)
