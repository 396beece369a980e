"""Text dumps as rows: debugger memory, parameter tables and register grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def memory_words(lines: DataFrame, value: str = "value") -> DataFrame:
    """(address, word) of lines such as ``00401000  0000002a ffffffff``: words of four bytes, one after the other."""
    words = F.filter(F.split(F.trim(F.regexp_extract(value, r"^[0-9a-fA-F]{8}\s+(.*)$", 1)), r"\s+"), lambda x: x.rlike("^[0-9a-fA-F]{8}$"))
    rows = lines.where(F.col(value).rlike(r"^[0-9a-fA-F]{8}\s+[0-9a-fA-F]{8}")).select(F.conv(F.substring(value, 1, 8), 16, 10).cast("long").alias("base"), F.posexplode(words).alias("i", "w"))
    return rows.select((F.col("base") + 4 * F.col("i")).alias("address"), F.conv("w", 16, 10).cast("long").alias("word"))


def dump_files(spark: SparkSession, path: str) -> DataFrame:
    """(dump, sha256, text) of the files below a folder: each named by its path, with the hash of its bytes and its text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("dump"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def parameters(text: DataFrame, overrides: DataFrame, value: str = "value") -> DataFrame:
    """(name, value) of ``name = number`` entries; an override (name, value, ord) replaces one, the last override winning."""
    entries = text.select(F.explode(F.regexp_extract_all(value, F.lit(r"([a-z][a-z0-9-]*\s*=\s*[0-9]+)"), 1)).alias("e"))
    base = entries.select(F.trim(F.split_part("e", F.lit("="), F.lit(1))).alias("name"), F.trim(F.split_part("e", F.lit("="), F.lit(2))).cast("long").alias("value"))
    last = overrides.groupBy("name").agg(F.max_by("value", "ord").alias("override"))
    return base.join(last, "name", "left").select("name", F.coalesce("override", "value").alias("value"))


def carried(rows: DataFrame, order: str, group: Column, tag: Column, name: str) -> DataFrame:
    """Each row of a dump with the latest tag at or before it, such as the function that a record belongs to."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(tag, ignorenulls=True).over(w))
