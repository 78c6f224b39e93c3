"""Session settings the package relies on, and the shared working folder."""

from __future__ import annotations

import re
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vitrine")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


#: Bytes of an Arrow batch on its way to a Python worker. A batch is held once in the JVM, in a buffer that doubles as it
#: grows, and once in the worker; Spark's own limits let 10,000 whole texts in.
BATCH_BYTES = 4 << 20


#: Largest side of a join that goes to all executors through the driver, by Spark's estimate. The estimate is a share of
#: a file's compressed size: ids of 8 MB by it were hundreds of MB in the driver's hash table.
BROADCAST_BYTES = 1 << 20


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone date computations assume, bound Arrow batches and broadcasts, and send this package's functions
    by value.

    Pickled by value, functions run on executors that do not have the package installed.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    first, later = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for key, limit in ((first, spark.conf.get(first)), (later, spark.conf.get(later, None))):  # unset, later is first
        if limit is not None and _bytes(limit) > BROADCAST_BYTES:
            spark.conf.set(key, str(BROADCAST_BYTES))
    cloudpickle.register_pickle_by_value(sys.modules["vitrine"])
    return spark


def working_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset (as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/vitrine/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str):
    """Write ``df`` below the shared folder and read it back: the lineage ends at files."""
    spark = df.sparkSession
    path = working_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
