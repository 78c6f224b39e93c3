"""Event-time counters over a stream, and the file-to-file runs the batch reports read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vitrine.session import working_dir

EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
          "props string")


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """A stream over event files with ``ts`` as an instant, which watermarks need."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counters(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Count and latency sums per event and day."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day"), "event_type")
            .agg(F.count("*").alias("n"), F.sum("value").alias("latency_sum"),
                 F.count("value").alias("latency_n"))
            .select(F.to_date("window.start").alias("day"), "event_type", "n", "latency_sum",
                    "latency_n"))


def rate_counters(events: DataFrame, tenant: str, limit: int, width: str = "1 minute",
                  delay: str = "10 minutes") -> DataFrame:
    """Requests per tenant and fixed window, flagged when over the limit (0: no limit)."""
    over = F.col("n") > limit if limit else F.lit(False)
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", width), F.col(tenant).alias("tenant_id"))
            .agg(F.count("*").alias("n"))
            .select("tenant_id", F.col("window.start").alias("window_start"), "n",
                    over.alias("over_limit")))


def trailing_counters(events: DataFrame, days: int = 7, delay: str = "1 hour") -> DataFrame:
    """Counts over the trailing ``days``, one window ending at each midnight."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", f"{days} days", "1 day"), "event_type")
            .agg(F.count("*").alias("n"))
            .select(F.date_sub(F.to_date("window.end"), 1).alias("day"), "event_type", "n"))


def once_per_id(events: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    """Drops redelivered events; the remembered ids expire with the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    """Process everything available into files below the shared folder and return them."""
    spark = stream.sparkSession
    base = working_dir(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if partition:
        writer = writer.partitionBy(partition)
    writer.start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_updates(stream: DataFrame, label: str, *keys: str) -> DataFrame:
    """Process everything available in update mode and return the newest row of each key, open windows included.

    Each micro-batch overwrites the folder of its own id, so a retried batch converges.
    """
    spark = stream.sparkSession
    base = working_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    (stream.writeStream.outputMode("update").foreachBatch(write)
     .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch_id", LongType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return rows.withColumn("_age", F.row_number().over(newest)).where("_age = 1").drop("_age", "batch_id")
