"""From documents to token ids: five stages, each one operator of millrace.llm.

Every stage works on all rows that the stage before it kept; what it keeps is written as Parquet
to the shared folder and read again. The first four return the columns of ``documents``, whatever
further columns there are and however these are named. A row is told from others by its id and text,
so rows that share an id are judged each by its own text.

Executors run Python workers all along, so a stage hands rows over in small batches (``C.bound_batches``).

Cases that hold in every stage: an empty table gives an empty one; texts are read whole, however
long; a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from millrace.llm import common as C

#: Models, byte-level encodings and near-duplicate groups can't be written in SQL.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no language's model accepts.

    Null, empty and letterless texts are rejected; repeated rows and rows without an id are judged by
    their text; without a labelled row to learn from every document is rejected.
    """
    C.bound_batches(spark)
    model = language_id.train(docs.select("doc_id", "text", "lang"), C.train_side())
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    named = language_id.identify(docs, model, prefix=prefix)
    return named.where(~F.col(f"{prefix}rejected")).select(*C.quoted(docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, keep the row with the largest id (any id before none).

    Of rows with one id and one text one is kept; empty and null texts are equal.
    """
    C.bound_batches(spark)
    done = exact_dedup.exact_dedup(docs, keep="largest").select(*C.KEY, "kept")
    return _keep(docs, done)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.75 or more, keep the one with the smallest id.

    Of linked rows of one smallest id, the one of smallest text hash; rows without an id come last.
    Texts without words are linked with nothing and stay.
    """
    C.bound_batches(spark)
    done = jaccard_join.jaccard_join(docs, links=False)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), *C.KEY)
    done = C.materialise(done.select("component", rank.alias("rank")), "linked")
    best = C.materialise(done.where("component is not null").groupBy("component").agg(F.min("rank").alias("best")), "best")
    stay = done.join(best, "component", "left").select("rank.did", "rank.rid", (F.col("best").isNull() | (F.col("rank") == F.col("best"))).alias("kept"))
    return _keep(docs, stay)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item's window occurs; all others stay, repeated rows and rows without an id too."""
    C.bound_batches(spark)
    done = decontaminate.decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    hit = C.materialise(done.where(F.size("spans") > 0).select(*C.KEY).distinct(), "gone")
    return _without(docs, hit)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids and the text they decode to; one row for each row, an empty text has no ids."""
    C.bound_batches(spark)
    return bpe.encode_and_decode(docs)


def _original(docs: DataFrame) -> DataFrame:
    """KEY and the whole row under one name, so that no column of ``docs`` meets one of ours."""
    key = C.keyed_columns()
    return docs.select(*[c.alias(n) for c, n in zip(key, C.KEY)], F.struct(*C.quoted(docs.columns)).alias("original"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("original").select(*[F.col("original")[c].alias(c) for c in columns])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose KEY is not among those of ``gone``, a written table."""
    return _unpacked(_original(docs).join(C.bounded_broadcast(gone), C.KEY, "left_anti"), docs.columns)


def _keep(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The rows that ``done`` (did, rid, kept) keeps, one of those that repeat an id and text."""
    per = done.groupBy(*C.KEY).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    per = C.materialise(per.where("not kept or n > 1"), "gone")
    repeated = per.where("kept").select(*C.KEY)
    gone = per.where("not kept").select(*C.KEY)
    if repeated.isEmpty():
        return _without(docs, gone)
    rows = _original(docs).join(C.bounded_broadcast(per.select(*C.KEY)), C.KEY, "left_anti")
    once = _original(docs).join(C.bounded_broadcast(repeated), C.KEY, "left_semi").dropDuplicates(C.KEY)
    return _unpacked(rows.union(once), docs.columns)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage's operator wrote, and the stage before, is removed once the stage's own rows are written."""
    docs = C.table(spark, sf_dir, "documents")
    before = list(getattr(spark, "_millrace_tables", ()))
    batches = spark.conf.get(C.BATCHES)
    try:
        for name, stage in STAGES:
            path = C.scratch_path(spark, f"stage-{name}")
            docs = C.written(stage(spark, docs, sf_dir), path)
            C.clear(spark, keep=[*before, path])
    finally:
        spark.conf.set(C.BATCHES, batches)
    return docs
