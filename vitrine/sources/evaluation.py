"""Evaluation datasets: a JSON array of queries, checked entry by entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = ("retrieval", "recommendation", "duplicate")
ENTRY = ("query_id string, task_type string, query string, text string, image_path string, "
         "product_id string, expected_products array<string>, is_duplicate boolean, top_k int")


class DatasetError(ValueError):
    """The dataset is malformed; the message names the entry."""


def parse_dataset(files: DataFrame, *keep: str) -> DataFrame:
    """Entries of (value) JSON documents with defaults filled in and a ``problem`` column; ``keep`` columns stay."""
    entries = files.select(
        *keep, F.from_json("value", "array<string>", {"mode": "PERMISSIVE"}).alias("raw"),
        F.regexp_like(F.col("value"), F.lit(r"^\s*\[")).alias("is_array"))
    rows = entries.select(*keep, "is_array", F.posexplode_outer("raw").alias("position", "raw")).withColumn(
        "e", F.from_json("raw", ENTRY, {"mode": "PERMISSIVE"}))
    filled = rows.select(
        *keep, "position", "is_array", "raw",
        F.coalesce(F.nullif("e.query_id", F.lit("")),
                   F.concat(F.lit("query-"), F.col("position").cast("string"))).alias("query_id"),
        F.coalesce("e.task_type", F.lit("retrieval")).alias("task_type"),
        F.coalesce("e.query", "e.text").alias("text"), F.col("e.image_path").alias("image_path"),
        F.col("e.product_id").alias("product_id"),
        F.coalesce("e.expected_products", F.array().cast("array<string>")).alias("expected_products"),
        F.col("e.is_duplicate").alias("is_duplicate"), F.col("e.top_k").alias("top_k"))
    problem = (
        F.when(~F.col("is_array"), "not a JSON array")
        .when(~F.coalesce(F.col("raw").startswith("{"), F.lit(False)), "not a JSON object")
        .when(~F.col("task_type").isin(*TASKS), "unknown task type")
        .when(F.col("top_k") <= 0, "top_k must be positive")
        .when((F.col("task_type") == "retrieval") & F.col("image_path").isNull()
              & (F.coalesce(F.trim("text"), F.lit("")) == ""), "needs text or image_path")
        .when((F.col("task_type") != "retrieval") & F.col("product_id").isNull(), "needs product_id"))
    return filled.withColumn("problem", problem)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Checked queries; the first bad entry raises ``DatasetError`` with its index."""
    parsed = parse_dataset(spark.read.text(path, wholetext=True))
    bad = parsed.filter(F.col("problem").isNotNull() & (
        F.col("position").isNotNull() | ~F.col("is_array"))).orderBy("position").first()
    if bad is not None:
        raise DatasetError(f"entry #{bad['position']} ({bad['query_id']}): {bad['problem']}")
    return parsed.filter(F.col("position").isNotNull()).drop("raw", "is_array", "problem")
