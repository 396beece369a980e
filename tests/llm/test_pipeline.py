"""The pipeline's stages on a small table with planted cases."""

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("world")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 200").first()
    long = base.where("n_chars > 1500 and lang = 'en'").orderBy("doc_id").first().text
    words = long.split()
    words[100] = "edited"
    rows = [(900001, long.upper(), "en", "s", 1), (900002, long.lower(), "en", "s", 1), (900003, " ".join(words), "en", "s", 1), (900004, f"start {item.text} end", "en", "s", 1), (900005, None, "en", "s", None), (900006, "12 34", None, None, 5), (900007, long + " one more tail", "en", "s", 1), (900007, long + " one more tail", "en", "s", 1)]
    base.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, world):
    docs = spark.read.parquet(f"{world}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a = P.keep_languages(spark, docs, world)
    assert a.columns == docs.columns
    assert set(ids(docs)) - set(ids(a)) == {900005, 900006}
    b = P.drop_copies(spark, a, world)
    assert b.columns == docs.columns and 900002 in ids(b) and 900001 not in ids(b) and ids(b).count(900007) == 1
    c = P.drop_near_copies(spark, b, world)
    assert c.columns == docs.columns and not {900003, 900007} & set(ids(c))
    d = P.drop_contaminated(spark, c, world)
    assert d.columns == docs.columns and 900004 not in ids(d)
    e = P.encode(spark, d, world)
    assert {r.doc_id: r.text for r in e.collect()} == {r.doc_id: r.text for r in d.collect()}


def test_run(spark, world):
    assert len(P.STAGES) == 5
    assert P.run(spark, world).count() > 0
