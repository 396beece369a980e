"""Equality is of contents: strings that a polynomial hash confuses, null ids, hot lists and single blocks."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, exact_dedup, jaccard_join, substring_dedup, token_counts, token_files
from millrace.llm import common as C

SCHEMA = "doc_id long, text string"


def alternating(n):
    """A string of n letters, each power of two of which is followed by its complement."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


A, B = alternating(1024)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_hashes_tell_alternating_strings_apart():
    for n in (64, 512, 1024):
        data = np.frombuffer((A[:n] + B[:n]).encode(), np.uint8)
        at = np.array([0, n])
        assert len(set(C.span_hashes(data, at, at + n).tolist())) == 2
        assert not C.same_spans(data, at, at + n, np.array([0, 0]))
    h = C.mix(np.array([c == "a" for c in A + B], np.uint64))
    assert len(set(C.sequence_hashes(h, np.array([0, 1024]), 1024).tolist())) == 2


def test_spans_compare_every_byte():
    r = np.random.default_rng(4)
    for n in (1, 7, 8, 9, 16, 17, 511, 512, 513, 2000):
        base = r.integers(0, 256, n, dtype=np.uint8)
        for at in {0, n // 2, n - 1}:
            other = base.copy()
            other[at] ^= 1
            data, starts = np.concatenate([base, base, other]), np.array([0, n, 2 * n])
            h = C.span_hashes(data, starts, starts + n)
            assert h[0] == h[1] != h[2]
            assert C.same_spans(data, starts, starts + n, np.array([0, 0, 2])) and not C.same_spans(data, starts, starts + n, np.array([0, 0, 0]))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_encoding(spark, library, tmp_path):
    docs = frame(spark, [(1, A), (2, B), (3, f"{A} {B}")]).coalesce(1)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in ((1, A), (2, B), (3, f"{A} {B}"))}
    for r in bpe.encode(docs).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
    token_files.write(docs, str(tmp_path / "f"))
    for r in token_files.read(spark, str(tmp_path / "f")).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*want[r.doc_id], 0]


def test_encoder_with_one_hash_for_all(monkeypatch, library):
    monkeypatch.setattr(C, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    v = bpe.Vocabulary(bpe.vocabulary_path())
    e = bpe.Encoder(v.special, lambda pieces: [bpe.merge(p, v) for p in pieces])
    text = "one two three one it's two"
    ((_, _, ids, _),) = e.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts(spark):
    m = token_counts.model(token_counts.model_path())
    texts = [A, B, f"{A} {B}", f" {A}  {B} "]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, list(enumerate(texts))).coalesce(1)).collect()}
    assert got == {i: len(m.encode(t)) for i, t in enumerate(texts)}


def test_jaccard(spark):
    letters = [" ".join(s) for s in alternating(64)]
    rest = " ".join(f"w{i}" for i in range(12))
    texts = [A, B, *letters, f"{A} {rest}", f"{B} {rest}"]
    got = [r.component_id for r in sorted(jaccard_join.jaccard_join(frame(spark, list(enumerate(texts))).coalesce(1)).collect())]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = shingles(a), shingles(b)
            assert (got[i] == got[j]) >= (100 * len(x & y) >= 75 * len(x | y))
    assert got[:2] == [0, 1] and len(set(got)) == 4  # the last two share all but one shingle's words


def test_substrings(spark):
    rest = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*rest[:30], A, *rest[30:]])), (2, " ".join([*rest[:30], B, *rest[30:]]))]
    rows += [(3, " ".join(A)), (4, " ".join(B[:512] + A[:512]))]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got[1] == got[2] == []
    first = {tuple(A[i : i + 50]) for i in range(975)}
    words = B[:512] + A[:512]
    gone = {q for p in range(975) if tuple(words[p : p + 50]) in first for q in range(p, p + 50)}
    assert {q for a, b in got[4] for q in range(a, b)} == gone


def test_null_ids(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (1, text), (2**60 + 1, text), (2**60 + 3, text + " end"), (None, "x")]
    docs = frame(spark, rows).coalesce(1)
    got = sorted((r.doc_id or 0, r.n_words, sum(b - a for a, b in r.removed)) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(0, 1, 0), (0, 80, 0), (1, 80, 0), (2**60 + 1, 80, 80), (2**60 + 3, 81, 80)]
    token_files.write(docs, str(tmp_path / "f"))
    back = token_files.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, None, 1, 2**60 + 1, 2**60 + 3]
    assert [r.start for r in back] == [sum(x.n_tokens for x in back[:k]) for k in range(5)]
    links = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}
    assert links == {(None, 1), (None, None), (1, 1), (2**60 + 1, 1), (2**60 + 3, 1)}


def test_one_block_alone():
    r = np.random.default_rng(3)
    counts = r.integers(50_000, 120_000, 12)
    ids = (r.zipf(1.3, int(counts.sum())) % 50257).astype(np.uint32)
    names = pa.array([None, *range(11)], pa.int64())
    raw = token_files.encode_segment(names, counts, ids)
    whole = list(token_files.decode_segment(raw))
    assert len(whole) > 3
    for k, (docs, n, part, before) in enumerate(whole):
        (alone,) = token_files.decode_segment(raw, k, len(whole))
        assert alone[0].equals(docs) and (alone[1] == n).all() and (alone[2] == part).all() and alone[3] == before == sum(len(x[2]) for x in whole[:k])
    assert pa.concat_arrays([x[0] for x in whole]).equals(names)
    # damage to one block leaves the others readable
    broken = bytearray(raw)
    broken[-1] ^= 1
    assert (next(token_files.decode_segment(bytes(broken), 0, len(whole)))[2] == whole[0][2]).all()
    with pytest.raises(ValueError):
        list(token_files.decode_segment(bytes(broken), len(whole) - 1, len(whole)))


def test_few_segments_are_read_by_many_tasks(spark, tmp_path):
    docs = frame(spark, [(i, f"word {i} " * 20_000) for i in range(8)]).coalesce(1)
    token_files.write(docs, str(tmp_path / "f"))
    back = token_files.read(spark, str(tmp_path / "f"))
    rows = back.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(8))
    want = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert all(zlib.crc32(r.ids) == zlib.crc32(bytes(want[r.doc_id]) + b"\0\0\0\0") for r in rows)
    assert back.rdd.getNumPartitions() > 1


def test_lookup_reads_hits_only(spark):
    texts = [f"text {i}" for i in range(3000)] + ["Same", "same", "SAME", "other", "Other"]
    docs = frame(spark, list(enumerate(texts)))
    found = exact_dedup.digests(docs)
    hits = exact_dedup.compact(exact_dedup.runs(found)).where("n > 1")
    assert {bytes(r.digest) for r in hits.collect()} == {hashlib.sha256(t).digest() for t in (b"same", b"other")}
    runs = [tuple(map(bytes, r)) for r in exact_dedup.filters(hits, memtable=1).collect()]
    assert len(runs) == 2 and all(low == high for low, high, _ in runs)
    passed = exact_dedup.representatives(docs, known=spark.sparkContext.broadcast(exact_dedup.Filters(runs))).collect()
    assert {bytes(r.norm) for r in passed} >= {b"same", b"other"} and len(passed) < 100
    for limit in (exact_dedup.FILTER_BYTES, 0):
        assert {bytes(r.norm) for r in exact_dedup.lookup(docs, hits, filter_bytes=limit).collect()} == {b"same", b"other"}
    assert exact_dedup.lookup(docs, hits.limit(0)).count() == 0


def test_passes_shuffle_hits_only(spark, monkeypatch):
    """With a filter a pass, no more texts leave their tasks than hits and the filters' errors."""
    texts = [f"text {i}" for i in range(3000)] + [f"copy {i % 40}" for i in range(200)]
    docs = frame(spark, list(enumerate(texts)))
    hits = C.materialise(exact_dedup.compact(exact_dedup.runs(exact_dedup.digests(docs))).where("n > 1"), "hits")
    passed, rows = [], exact_dedup.representatives

    def counted(*args):
        passed.append(rows(*args).count())
        return rows(*args)

    monkeypatch.setattr(exact_dedup, "representatives", counted)
    found = {}
    for limit in (exact_dedup.FILTER_BYTES, 300, 0):
        passed.clear()
        found[limit] = {(bytes(r.digest), bytes(r.norm)) for r in exact_dedup.lookup(docs, hits, filter_bytes=limit, memtable=5).collect()}
        assert sum(passed) < 600, passed
        assert (len(passed) == 1) == (limit == exact_dedup.FILTER_BYTES)
    assert len(found[0]) == 40 and len(set(map(frozenset, found.values()))) == 1


def test_filters_never_miss():
    r = random.Random(8)
    known = sorted(r.randbytes(32) for _ in range(5000))
    runs = []
    for at in range(0, 5000, 700):
        part = known[at : at + 700]
        marks = np.zeros(1 << 13, bool)
        marks[(exact_dedup._places(part) % np.uint64(1 << 13)).astype(np.int64).ravel()] = True
        runs.append((part[0], part[-1], np.packbits(marks, bitorder="little").tobytes()))
    f = exact_dedup.Filters(runs)
    assert all(f.maybe(known))
    assert sum(f.maybe([r.randbytes(32) for _ in range(5000)])) < 500
    assert f.maybe([]) == [] and exact_dedup.Filters([]).maybe([b"x"]) == [False]


def test_a_list_of_many_unlinked_members(spark):
    r = random.Random(6)
    shared = "alpha beta gamma delta epsilon"
    texts = [f"{shared} " + " ".join(f"{r.randrange(10**9)}" for _ in range(r.choice([20, 21, 27, 28]))) for _ in range(10_000)]
    texts += [texts[5] + " one", texts[77].replace("alpha", "alpha", 1) + " two three"]
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_join(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {**{i: i for i in range(10_000)}, 10_000: 5, 10_001: 77}


def test_rows_of_one_id_are_apart(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (7, " ".join(words[:-1])), (7, "something else altogether that nobody wrote before now"), (7, "something else altogether that nobody wrote before now")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect())
    assert got == [(1, 56, 1), (7, 4, 7), (7, 4, 7), (7, 55, 1)]


def test_a_large_benchmark_gives_the_same(spark, monkeypatch):
    from millrace.llm import decontaminate

    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(r.choice([1, 2, 3, 5, 10, 11, 25]))) for k in range(40)] + [("i1", text(10)), ("none", "..."), (None, text(12)), ("null", None)]
    docs = [(i, " ".join([text(r.randrange(30)), r.choice(items)[1] or "", text(r.randrange(8)), r.choice(items)[1] or ""])) for i in range(120)] + [(5, None), (None, items[0][1]), (6, "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame_ = frame(spark, docs)
    got = []
    for limit, keys in ((1 << 20, 1 << 23), (0, 1 << 23), (0, 0)):
        monkeypatch.setattr(decontaminate, "FILTER_KEYS", keys)
        out = decontaminate.decontaminate(frame_, bench, broadcast_bytes=limit).collect()
        got.append(sorted(((x.doc_id, x.n_words, [tuple(s) for s in x.spans], x["items"]) for x in out), key=str))
    assert got[0] == got[1] == got[2] and any(x[3] for x in got[0])
