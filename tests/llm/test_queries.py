"""The numbered queries against SQL, and against brute force where SQL can't express them, on the smallest tables."""

import hashlib
import struct
import zlib

import duckdb
import pytest

from millrace.llm import bpe, queries, sql, token_counts

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


def run(spark, name):
    return queries.queries()[name](spark, DIR)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = run(spark, name)
    got = duck.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=str) == sorted((tuple(r[columns.index(c)] for c in order) for r in got.fetchall()), key=str)


def test_op2_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = {r.doc_id: r for r in run(spark, "op2_bpe_codec").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op4_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op4_token_files").collect()}
    start = 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 0]
        assert got.pop(i) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not got


def test_op8_equals_the_library(spark, texts):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op8_token_counts").collect()}
    assert got == {i: (len(t.encode()), n := len(m.encode(t)), n > 4096) for i, t in texts.items()}


def test_op3_held_out_accuracy(spark, duck):
    truth = dict(duck.execute("select doc_id, lang from documents").fetchall())
    rows = run(spark, "op3_language_id").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_op5_held_out_accuracy(spark, duck):
    truth = dict(duck.execute("select doc_id, quality from labels").fetchall())
    rows = run(spark, "op5_quality").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
