"""Strict tab-separated tables, rule bases and progress reports."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X

SYMBOLS = ["address", "size", "symbol", "evidence"]


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', schema=schema, enforceSchema=False, mode="FAILFAST")


def symbol_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows (address, size, symbol, evidence) of a table with exactly that header.

    Addresses are hexadecimal, sizes decimal and not negative, symbols unique; anything else fails
    the query that reads the rows.
    """
    rows = _tsv(spark, path, SYMBOLS)
    place, size = X.address(F.col("address")), F.col("size").try_cast("long")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce("symbol", F.lit("?"))))
    rows = rows.select(
        F.when(F.col("address").rlike("^0x[0-9a-fA-F]+$") & place.isNotNull(), place).otherwise(fail("bad address of ").cast("decimal(20,0)")).alias("address"),
        F.when(size >= 0, size).otherwise(fail("bad size of ").cast("long")).alias("size"),
        "symbol",
        "evidence",
    )
    twice = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    checked = twice.select("symbol", F.when(F.col("n") == 1, True).otherwise(fail("repeated symbol ").cast("boolean")).alias("single"))
    return rows.join(checked, "symbol").where("single").select(*SYMBOLS)


def write_symbol_table(rows: DataFrame, path: str) -> None:
    """The table's text form, ordered by address and symbol across its files."""
    text = rows.select(F.concat(F.lit("0x"), F.lower(F.hex(F.col("address").cast("long")))).alias("address"), F.col("size").cast("string").alias("size"), "symbol", "evidence", F.col("address").alias("at"))
    ordered = text.repartitionByRange("at", "symbol").sortWithinPartitions("at", "symbol").drop("at")
    ordered.write.csv(path, sep="\t", header=True, quote='"', escape='"')


_EVIDENCE = ["commit", "function", "note"]
_PLAIN = ["id", "cause", "status", "symptom", "fix"]
RULES = ", ".join(["base string", *(f"{c} string" for c in _PLAIN), "evidence array<struct<" + ",".join(f"{c}:string" for c in _EVIDENCE) + ">>"])


def rule_bases(files: DataFrame) -> DataFrame:
    """(base, id, cause, status, symptom, fix, evidence) of rule bases in TOML, from rows (base, content): a file's [[idiom]] tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for base, content in zip(frame["base"], frame["content"]):
                for rule in tomllib.loads(bytes(content).decode()).get("idiom", []):
                    out.append((base, *(rule.get(c) for c in _PLAIN), [{k: e.get(k) for k in _EVIDENCE} for e in rule.get("evidence", [])]))
            yield pd.DataFrame(out, columns=["base", *_PLAIN, "evidence"])

    return files.select("base", "content").mapInPandas(run, RULES)


def rule_files(spark: SparkSession, path: str, glob: str = "*.toml") -> DataFrame:
    """(base, content): the catalog of rule bases below a folder, by file name, or by the folder ``base=`` that a job wrote one to."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    folder = F.nullif(F.regexp_extract("path", r"/base=([^/]+)/[^/]+$", 1), F.lit(""))
    return found.select(F.coalesce(folder, F.regexp_extract("path", r"([^/]+)\.toml$", 1)).alias("base"), "content")


def rules(spark: SparkSession, text: str) -> DataFrame:
    """Rows of one rule base given as text."""
    return rule_bases(spark.createDataFrame([("", text.encode())], "base string, content binary")).drop("base")


def rules_for(rules: DataFrame, causes: DataFrame, cause: str = "cause") -> DataFrame:
    """Rules whose cause is among those of ``causes``."""
    return rules.join(causes.select(F.col(cause).alias("cause")).distinct(), "cause", "left_semi")


def bindings(spark: SparkSession, path: str) -> DataFrame:
    """(name, address, unit) of a tab-separated bindings file: named rows of space ``text``; comment lines are skipped."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", schema="space string, rva string, name string, unit string", enforceSchema=False)
    return rows.where("space = 'text' and name <> ''").select("name", X.address(F.col("rva")).alias("address"), "unit")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(unit, symbol, best) of a tab-separated baseline without header: lines of eight fields or more that are no comment."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(fields) >= 8))
    return rows.select(fields[0].alias("unit"), fields[1].alias("symbol"), fields[2].cast("double").alias("best"))


def with_baseline(functions: DataFrame, best: DataFrame, names: DataFrame) -> DataFrame:
    """Report rows (unit, name, size, score) as verdicts: exact where the banked best or this build's score is 100; addresses by name."""
    banked = best.select("unit", F.col("symbol").alias("name"), "best")
    rows = functions.select("unit", "name", "size", "score").join(banked, ["unit", "name"], "left").join(names.select("name", "address"), "name", "left")
    return rows.withColumn("best", F.coalesce("best", "score")).withColumn("exact", (F.col("best") == 100) | (F.col("score") == 100))


_FUNCTION = "struct<name:string,size:string,fuzzy_match_percent:double,metadata:struct<demangled_name:string,virtual_address:string>>"
REPORT = f"units array<struct<name:string,functions:array<{_FUNCTION}>,metadata:struct<source_path:string,progress_categories:array<string>>>>"


def report_functions(spark: SparkSession, path: str) -> DataFrame:
    """(unit, source, name, address, size, score, exact) of progress reports; numbers come as decimal strings, no score means 0."""
    return flatten_report(spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path))


def flatten_report(report: DataFrame) -> DataFrame:
    """The same of report rows (units)."""
    each = report.select(F.explode("units").alias("u")).select("u.name", "u.metadata.source_path", F.explode("u.functions").alias("f"))
    score = F.coalesce("f.fuzzy_match_percent", F.lit(0.0))
    return each.select(F.col("name").alias("unit"), F.col("source_path").alias("source"), F.col("f.name").alias("name"), X.address(F.col("f.metadata.virtual_address")).alias("address"), F.col("f.size").cast("long").alias("size"), score.alias("score"), (score == 100).alias("exact"))


_SECTION = "struct<name:string,exact:boolean,functions:array<struct<symbol:string,address:string,size:bigint,exact:boolean,exact_but_unknown:boolean>>>"


MATCHES = f"unit string, sections array<{_SECTION}>"


def match_functions(spark: SparkSession, path: str) -> DataFrame:
    """(unit, section, symbol, key, address, size, exact) of per-unit match reports."""
    return flatten_matches(spark.read.schema(MATCHES).option("multiLine", True).json(path))


def flatten_matches(report: DataFrame) -> DataFrame:
    """The same of report rows (unit, sections)."""
    each = report.select("unit", F.explode("sections").alias("s")).select("unit", F.col("s.name").alias("section"), F.explode("s.functions").alias("f"))
    return each.select("unit", "section", "f.symbol", X.function_key(F.col("f.symbol"), F.col("f.address")).alias("key"), X.address(F.col("f.address")).alias("address"), "f.size", F.coalesce("f.exact", F.lit(False)).alias("exact"))
