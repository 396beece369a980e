"""A census that saves what each batch finds, stops anywhere and goes on from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Stopped(RuntimeError):
    """Raised by a census that was asked to stop after a batch."""


def run(rows: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, stop_after: int | None = None) -> None:
    """Analyse a stream's rows batch by batch, all that is there now, and save each batch's results below ``out``.

    A batch's results replace what is there of the same batch, so one that was saved but not committed
    when the job stopped is saved once. The checkpoint says which batches are done; a later call goes on after
    them. ``stop_after`` ends the job after that batch was saved and before it is committed, as a lost driver would.
    """

    def save(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == stop_after:
            raise Stopped(f"after batch {number}")

    query = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def found(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All saved results with their ``batch``; partial as long as the census goes on."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)


def ranking(results: DataFrame, key: list[str], count: str, size: str) -> DataFrame:
    """(key..., n_units, n, bytes): what was found over all units, to be ordered by n, most first."""
    return results.groupBy(*key).agg(F.count_distinct("unit").alias("n_units"), F.sum(count).alias("n"), F.sum(size).alias("bytes"))
