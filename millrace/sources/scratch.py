"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a folder of our own only on one machine where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_millrace_scratch", None)
        if root is None:
            root = spark._millrace_scratch = tempfile.mkdtemp(prefix="spark-millrace-")
    path = f"{root.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    spark._millrace_scratch_tables = [*getattr(spark, "_millrace_scratch_tables", ()), path]
    return path


def clear(spark: SparkSession) -> None:
    """Remove this session's tables. Frames that read them can't be used any more."""
    for path in getattr(spark, "_millrace_scratch_tables", ()):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._millrace_scratch_tables = []


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write the rows as Parquet and read them back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
