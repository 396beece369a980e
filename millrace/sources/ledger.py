"""Append-only ledgers in JSON Lines, as batch tables and as a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key columns of every ledger row; whatever else a row has is in ``payload``.
KEYS = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "command", "unit", "symbol")])


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a ledger: blank lines are no rows, an absent path has none, a malformed row fails the read.

    Without a schema a row is its key columns and the whole row as ``payload`` (a variant).
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    lines = lines.where(F.trim("value") != "")
    options = {"mode": "FAILFAST"}
    if schema is not None:
        return lines.select(F.from_json("value", schema, options).alias("row")).select("row.*")
    return lines.select(F.from_json("value", KEYS, options).alias("row"), F.parse_json("value").alias("payload")).select("row.*", "payload")


def record(rows: DataFrame, path: str) -> None:
    """Append rows with the time of writing, columns in order of name, nulls left out."""
    dated = rows.withColumn("date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    dated.select(*sorted(dated.columns)).write.mode("append").json(path)


def stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New rows of a ledger folder as they are appended."""
    return spark.readStream.schema(schema).json(path)
