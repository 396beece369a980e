"""The registered queries: each applies its operator to a whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, exact_dedup, filter_audit, jaccard_join, language_id, line_dedup, mixing, quality, spelling, substring_dedup, token_counts, token_files
from millrace.llm import common as C


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(C.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(C.table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, C.train_side())
    done = language_id.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (~C.train_side()).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = C.scratch_path(spark, "token-files")
    token_files.write(C.table(spark, sf_dir, "documents"), to)
    return token_files.read(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, C.table(spark, sf_dir, "labels"), C.train_side())
    done = quality.rate(docs, field)
    return done.select("doc_id", (~C.train_side()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines", "n_good")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_dedup.exact_dedup(C.table(spark, sf_dir, "documents"), keep="largest")
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = token_counts.token_counts(C.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(C.table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return done.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return done.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spelling.spelling_variants(C.table(spark, sf_dir, "documents"))
    return done.select("word", "form", "root", "n", "n_near", "form_n")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_bpe_codec": op2_bpe_codec,
        "op3_language_id": op3_language_id,
        "op4_token_files": op4_token_files,
        "op5_quality": op5_quality,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_source_mix": op12_source_mix,
        "op13_filter_audit": op13_filter_audit,
    }
