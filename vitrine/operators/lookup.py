"""Key access over whole request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_existing(ids: DataFrame, collection: DataFrame) -> DataFrame:
    """Adds ``indexed``: whether each ``product_id`` is in the collection."""
    known = collection.select("product_id").distinct().withColumn("_hit", F.lit(True))
    return ids.join(known, "product_id", "left").withColumn(
        "indexed", F.coalesce("_hit", F.lit(False))).drop("_hit")


def retrieve(ids: DataFrame, collection: DataFrame) -> DataFrame:
    return ids.join(collection, "product_id")


def retrieve_with_fallback(ids: DataFrame, first: DataFrame, second: DataFrame,
                           columns: list[str], labels: tuple[str, str]) -> DataFrame:
    """Values from the first collection that holds the id, and which one it was."""
    a = first.select("product_id", F.struct(*columns).alias("_a"))
    b = second.select("product_id", F.struct(*columns).alias("_b"))
    joined = ids.join(a, "product_id", "left").join(b, "product_id", "left")
    source = F.when(F.col("_a").isNotNull(), labels[0]).when(F.col("_b").isNotNull(), labels[1])
    picked = F.when(F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("_b"))
    return joined.withColumn("found_in", source).withColumn("_p", picked).select(
        *ids.columns, "found_in", *[F.col(f"_p.{c}").alias(c) for c in columns])


def batch_resolve(requests: DataFrame, collection: DataFrame) -> DataFrame:
    """(request_id, product_id, position, found): ids once per request, in first-asked order.

    ``requests`` has one row per asked id with its ``position``.
    """
    once = requests.groupBy("request_id", "product_id").agg(F.min("position").alias("position"))
    return flag_existing(once, collection).withColumnRenamed("indexed", "found")


def coverage(image: DataFrame, text: DataFrame) -> DataFrame:
    """Per id, which of the two collections holds it, when they disagree."""
    a = image.select("product_id").distinct().withColumn("in_image", F.lit(True))
    b = text.select("product_id").distinct().withColumn("in_text", F.lit(True))
    both = a.join(b, "product_id", "full_outer").na.fill(False, ["in_image", "in_text"])
    return both.filter(F.col("in_image") != F.col("in_text"))
