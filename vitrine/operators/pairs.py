"""Bring target and candidate payload next to each hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.fuzzy import pieces, sorted_tokens


def pair_up(hits: DataFrame, targets: DataFrame, candidates: DataFrame, columns: list[str]) -> DataFrame:
    """Joins ``t_<column>`` of the query's own product and ``c_<column>`` of the candidate."""
    t = targets.select(F.col("product_id").alias("query_id"),
                       *[F.col(c).alias(f"t_{c}") for c in columns])
    c = candidates.select("product_id", *[F.col(x).alias(f"c_{x}") for x in columns])
    return hits.join(c, "product_id").join(t, "query_id")


def with_tokens(products: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``tok_<column>``, the form fuzzy comparison takes, once per product."""
    return products.withColumns({f"tok_{c}": sorted_tokens(F.col(c)) for c in columns})


def with_letters(products: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``abc_<column>``, the numbered letters of ``tok_<column>``, once per product."""
    return products.withColumns({f"abc_{c}": pieces(F.col(f"tok_{c}"), 1) for c in columns})


def hydrate(hits: DataFrame, products: DataFrame, columns: list[str]) -> DataFrame:
    """Attach payload columns to hits."""
    return hits.join(products.select("product_id", *columns), "product_id")


COMPARED_FIELDS = (
    "name", "brand", "category", "price", "description", "color", "material", "gender", "style",
)


def compare_fields(pairs: DataFrame, targets: DataFrame, candidates: DataFrame,
                   fields: list[str]) -> DataFrame:
    """Per pair and field: same, different, or incomparable when either side is missing."""
    joined = pair_up(pairs.select("query_id", "product_id"), targets, candidates, fields)
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").cast("string").alias("left_value"),
                 F.col(f"c_{f}").cast("string").alias("right_value"))
        for f in fields]))
    long = joined.select("query_id", "product_id", cells.alias("x")).select(
        "query_id", "product_id", "x.*")
    missing = (F.coalesce(F.col("left_value"), F.lit("")) == "") | (
        F.coalesce(F.col("right_value"), F.lit("")) == "")
    same = F.lower(F.trim("left_value")) == F.lower(F.trim("right_value"))
    return long.withColumn("verdict", F.when(missing, "incomparable").when(same, "same")
                           .otherwise("different"))
