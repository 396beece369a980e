"""What executors and their Python workers hold: bounded batches, and nothing of an operator whose turn is over."""

import pyarrow as pa
import pytest

import corpus_pipeline as P
from millrace.llm import bpe
from millrace.llm import common as C


@pytest.fixture
def batches(spark):
    """Spark's own bound on batches, set back after the test."""
    before = spark.conf.get(C.BATCHES)
    yield before
    spark.conf.set(C.BATCHES, before)


def _sizes(df) -> list[tuple[int, int]]:
    def run(found):
        for b in found:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return [(r.n, r.size) for r in df.mapInArrow(run, "n long, size long").collect()]


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_a_stage_bounds_the_bytes_of_batches(spark, batches, name):
    text = "some words of a text " * 500
    docs = spark.range(0, 1200, 1, 1).selectExpr("id as doc_id", f"concat(id, ' {text}') as text", "'en' as lang", "'s' as source", "1L as n_chars")
    row = len(text) + 200
    dict(P.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    sizes = _sizes(docs)
    assert sum(n for n, _ in sizes) == 1200 and max(s for _, s in sizes) <= C.BATCH_BYTES + row


def test_smaller_batches_and_longer_rows_stay(spark, batches):
    spark.conf.set(C.BATCHES, "1m")
    C.bound_batches(spark)
    assert spark.conf.get(C.BATCHES) == "1m"
    spark.conf.set(C.BATCHES, batches)
    C.bound_batches(spark)
    docs = spark.range(0, 3, 1, 1).selectExpr("id as doc_id", "repeat('long text ', 1000000) as text")
    assert [n for n, _ in _sizes(docs)] == [1, 1, 1]
    assert [len(r.text) for r in bpe.encode_and_decode(docs).collect()] == [10_000_000] * 3


def test_run_sets_the_bound_back(spark, batches):
    P.run(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(C.BATCHES) == batches


def test_a_worker_drops_what_another_operator_kept(spark):
    docs = spark.range(0, 50, 1, 1).selectExpr("id as doc_id", "concat('text ', id) as text")

    def held(operator):
        def run(found):
            for _ in found:
                pass
            yield pa.RecordBatch.from_arrays([pa.array([len(C._kept)])], ["n"])

        return C.map_arrow(docs, run, "n long", operator).first().n

    held(None)  # with one task at a time all are the same worker's
    assert bpe.encode_and_decode(docs).count() == 50
    assert held(bpe.OPERATOR) >= 3
    assert held(None) == 0
    assert held(bpe.OPERATOR) == 0


def test_kept_is_made_once_and_dropped_for_others():
    made = []
    for _ in range(2):
        C.kept("a", "x", lambda: made.append(1))
    C.forget_others("a")
    C.kept("a", "x", lambda: made.append(1))
    assert made == [1]
    C.forget_others("b")
    C.kept("a", "x", lambda: made.append(1))
    assert made == [1, 1]
    C.forget_others(None)


def test_encoder_and_decoder_share_a_vocabulary():
    C.forget_others(None)
    path = bpe.vocabulary_path()
    bpe.tree_encoder(path), bpe._decoder(path)
    assert [name for _, name in C._kept].count(f"vocabulary {path}") == 1
