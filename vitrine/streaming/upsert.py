"""Idempotent streaming upserts and the ingest-time duplicate gate.

Each micro-batch overwrites its own ``batch_id`` folder, so a retried batch converges; readers
take the newest row per key, and ``compact`` folds the folders into one when they pile up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.duplicates import gate
from vitrine.sources.sinks import latest


def write_batch(batch: DataFrame, batch_id: int, path: str, key: str, version: str) -> None:
    latest(batch, key, F.col(version)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start_upsert(stream: DataFrame, path: str, checkpoint: str, *, key: str = "product_id",
                 version: str = "version",
                 prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Starts the stream; ``prepare`` may check or gate each micro-batch before it is written."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        write_batch(rows, batch_id, path, key, version)

    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current(spark: SparkSession, path: str, schema, *, key: str = "product_id",
            version: str = "version") -> DataFrame:
    """The table a reader sees: the newest version of each key over all batches."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    return latest(rows, key, F.col(version), F.col("batch_id")).drop("batch_id")


def compact(table: DataFrame, path: str) -> None:
    """Write the current table as the single batch of a new path."""
    table.write.mode("overwrite").parquet(f"{path}/batch_id=0")


def gate_with(find: Callable[[DataFrame], DataFrame], mode: str) -> Callable[[DataFrame], DataFrame]:
    """A ``prepare`` step: ``find`` returns duplicate decisions for the new rows of a batch."""
    def prepare(batch: DataFrame) -> DataFrame:
        if mode == "off":
            return batch
        return gate(batch, find(batch), mode).select(*batch.columns)

    return prepare
