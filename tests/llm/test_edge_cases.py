"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, quality, substring_dedup, token_counts, token_files
from millrace.llm import common as C
from millrace.llm.components import components
from millrace.llm.pretokens import pretoken_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, kept boolean, score string"


def make(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None, 1, "d", True, "s") for i, t in zip(ids, texts)], SCHEMA)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


LONG = words(30_000, 7)
ODD = [None, "", " ", "\n\n", "a", "A", LONG, LONG.upper(), "ß é 日本 　 🎉", "x " * 500, "<|endoftext|> it's"]
APPLY = {
    "line_dedup": lambda d: line_dedup.line_dedup(d),
    "bpe": lambda d: bpe.decode(bpe.encode(d)),
    "token_counts": lambda d: token_counts.token_counts(d),
    "exact_dedup": lambda d: exact_dedup.exact_dedup(d),
    "substring_dedup": lambda d: substring_dedup.substring_dedup(d),
    "jaccard_join": lambda d: jaccard_join.jaccard_join(d),
    "quality": lambda d: quality.rate(d, quality.train(d, d.select("doc_id", d.n_chars.alias("quality")))),
    "language_id": lambda d: language_id.identify(d, language_id.train(d)),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(d.doc_id.alias("item_id"), "text").where("length(text) < 30")),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_every_row_has_a_result(spark, name):
    docs = make(spark, [*ODD, "again", "again"], [*range(len(ODD)), 100, 100])  # a repeated row
    docs = docs.union(make(spark, ["null id"], [None]))
    assert APPLY[name](docs).count() == docs.count()


@pytest.mark.parametrize("name", sorted(APPLY))
def test_empty_table(spark, name):
    assert APPLY[name](make(spark, ["x"]).limit(0)).count() == 0


def test_token_files_edge_cases(spark, tmp_path):
    docs = make(spark, [*ODD, "again", "again"], [*range(len(ODD)), 100, 100])
    token_files.write(docs, str(tmp_path / "f"))
    got = token_files.read(spark, str(tmp_path / "f")).collect()
    assert len(got) == docs.count()
    assert sorted(r.n_tokens for r in got if r.doc_id in (0, 1)) == [1, 1]
    token_files.write(docs.limit(0), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_coding_round_trip_and_checksum():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (40, 5), (5000, 50257), (300_000, 50257), (70_000, 1)):
        ids = (r.zipf(1.3, n) % top).astype(np.uint32)
        counts = np.diff(np.concatenate([[0], np.sort(r.integers(0, n + 1, min(n, 20))), [n]]))
        counts = counts[counts > 0]
        raw = token_files.encode_segment(np.arange(len(counts)), counts, ids)
        assert (np.concatenate([b[2] for b in token_files.decode_segment(raw)]) == ids).all()
    broken = bytearray(raw)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        list(token_files.decode_segment(bytes(broken)))


def test_encoder_equals_library_on_odd_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    r = random.Random(5)
    parts = [*"ab'sltrevdm  \n\t1é½!?日", "'re", "'ll", "<|endoftext|>", " ", "　", "\x1c"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1500)]
    out = []
    for _, _, ids, n in bpe.tree_encoder(bpe.vocabulary_path()).encode(pa.array(texts)):
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert out == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encode_and_decode_in_one(spark):
    docs = make(spark, ODD)
    two, one = (sorted(tuple(r) for r in f.collect()) for f in (bpe.decode(bpe.encode(docs)), bpe.encode_and_decode(docs)))
    assert one == two and [r[3] for r in one] == [t or "" for t in ODD]


def test_cache_that_shrinks_gives_the_same_ids():
    v = bpe.Vocabulary(bpe.vocabulary_path())
    small = bpe.Encoder(v.special, lambda pieces: [bpe.merge(p, v) for p in pieces], entries=60)
    texts = [words(40, i % 7) for i in range(30)]
    for t in texts:
        (_, _, ids, _), = small.encode(pa.array([t]))
        (_, _, want, _), = bpe.tree_encoder(bpe.vocabulary_path()).encode(pa.array([t]))
        assert ids.tolist() == want.tolist()


def test_pretokens_cover_the_text():
    data = np.frombuffer("it's  a\n\n test".encode(), np.uint8)
    s, _ = pretoken_spans(data, np.array([0, len(data)]))
    assert [bytes(p) for p in np.split(data, s[1:])] == [b"it", b"'s", b" ", b" a", b"\n\n", b" test"]


def test_token_counts_with_small_head(spark):
    texts = [words(50, i % 3) + "  x▁ y" for i in range(9)]
    m = token_counts.model(token_counts.model_path())
    for head in (0, 5, 1000):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make(spark, texts), head=head).collect()}
        assert got == {i: len(m.encode(t)) for i, t in enumerate(texts)}


def test_exact_dedup_splits_colliding_digests(spark):
    texts = ["Aa", "aA", "b", "c", "c", None, ""]
    for digest in (exact_dedup.sha256, lambda b: b"same"):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(make(spark, texts), digest=digest).collect()}
        assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (4, 2, False), 4: (4, 2, True), 5: (6, 2, False), 6: (6, 2, True)}
    small = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(make(spark, texts), keep="smallest").collect()}
    assert small == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    got = exact_dedup.exact_dedup(make(spark, ["x", "x", "x"], [5, 5, 3])).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(3, False), (5, False), (5, True)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_jaccard_join_equals_brute_force(spark):
    r = random.Random(11)
    texts = []
    for base in range(6):
        w = words(r.choice([3, 6, 9, 14, 60, 200]), base).split()
        for _ in range(12):  # copies that lie about the threshold
            v = list(w)
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                v[r.randrange(len(v))] = "edit%d" % r.randrange(10**6)
            texts.append(" ".join(v))
    texts += [None, "", "a b", "a b", " ".join(words(20, 1).split()[:8])]
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_join(make(spark, texts)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert len(set(label)) < len(label)


def test_boundary_weighs_subsets_against_lists():
    assert jaccard_join.boundary({}) >= 1
    assert jaccard_join.subsets(4, 12) == sum(1 if b >= 4 else 4 for b in (3, 4, 5)) + (0 if jaccard_join.need(4, 3) == 3 else 0)


def test_substring_dedup_equals_brute_force(spark):
    r = random.Random(2)
    shared = [words(n, 100 + n).split() for n in (50, 51, 80, 200)]
    texts = []
    for i in range(25):
        w = []
        for _ in range(r.randint(1, 4)):
            s = r.choice(shared)
            cut = r.randint(0, 20)
            w += words(r.randint(0, 60), r.randrange(10**6)).split() + s[cut:] + (["be"] * 70 if r.random() < 0.3 else [])
        texts.append(" ".join(w))
    texts += [None, "", texts[0], texts[3]]
    first = {}
    each = [(t or "").split() for t in texts]
    for i, w in enumerate(each):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = {}
    for i, w in enumerate(each):
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        want[i] = (len(w), " ".join(x for q, x in enumerate(w) if q not in gone))
    got = {x.doc_id: (x.n_words, x.kept) for x in substring_dedup.substring_dedup(make(spark, texts)).collect()}
    assert got == want


def test_decontaminate_in_blocks_equals_one_block(spark):
    items = [words(n, n) for n in (3, 9, 10, 25)] + [None, "", "The ... end"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    docs = make(spark, [f"pre {items[2].upper()}! post", items[3] + " " + items[0], "nothing here", "THE. END", None])
    one, many = ({r.doc_id: (r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in decontaminate.decontaminate(docs, bench, broadcast_bytes=b).collect()} for b in (1 << 20, 40))
    assert one == many
    assert one[0] == (12, [(1, 11)], ["2"]) and one[1] == (28, [(0, 28)], ["0", "3"]) and one[3] == (2, [(0, 2)], ["6"]) and one[2][1] == []


def test_line_dedup_generalises_fields(spark):
    line = "Page {} of the site visited by {} at noon"
    docs = make(spark, [line.format(i, n) + f"\n{words(9, i)}" for i, n in enumerate(["ann", "bob", "cyd", "dan"])] + ["short line", "short line", "short line"])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(docs).collect()}
    assert all(got[i] == (2, 1, words(9, i)) for i in range(4))
    assert got[4] == (1, 1, "")  # a line of two tokens that three documents have


def test_language_rejection(spark):
    import itertools

    texts = [f"the cat and the dog are {w} in the house {i}" for i, w in enumerate(itertools.islice(itertools.cycle(["happy", "asleep", "here"]), 60))]
    model = language_id.train(make(spark, texts))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language_id.identify(make(spark, ["the dog is here", "12 34", None, "жышцъ щфюъ"]), model).collect()}
    assert got == {0: ("en", False), 1: ("und", True), 2: ("und", True), 3: ("en", True)}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(100)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_split_by_id(spark):
    got = spark.range(50).toDF("doc_id").select("doc_id", C.train_side().alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.doc_id).encode()) % 4 != 2) for r in got)
