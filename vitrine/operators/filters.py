"""Row filters: facets, prices, input checks and the view filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, IntakeConfig
from vitrine.functions.scalars import blank_to_null, facet_key, rounded, strip


def filter_products(products: DataFrame, *, brand: str | None = None, category: str | None = None,
                    min_price: float | None = None, max_price: float | None = None) -> DataFrame:
    """Products passing one set of literal filters; Catalyst pushes the bounds to the scan."""
    out = products
    if brand is not None:
        out = out.filter(facet_key(F.lit(brand)).isNull() | (F.col("brand_key") == facet_key(F.lit(brand))))
    if category is not None:
        out = out.filter(facet_key(F.lit(category)).isNull()
                         | (F.col("category_key") == facet_key(F.lit(category))))
    if min_price is not None:
        out = out.filter(F.col("price") >= min_price)
    if max_price is not None:
        out = out.filter(F.col("price") <= max_price)
    return out


def zero_result_filters(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries that set some filter and got no hit at all."""
    any_filter = reduce(lambda a, b: a | b, [
        F.col(c).isNotNull() for c in ("brand_key", "category_key", "min_price", "max_price")
        if c in queries.columns])
    return queries.filter(any_filter).join(hits.select("query_id"), "query_id", "left_anti")


def check_query_presence(queries: DataFrame) -> DataFrame:
    """Adds ``mode`` (image, text, hybrid) or a reject reason when a query has neither side."""
    has_image = F.col("image_vector").isNotNull()
    has_text = blank_to_null(F.col("text")).isNotNull()
    return queries.withColumn(
        "mode",
        F.when(has_image & has_text, "hybrid").when(has_image, "image").when(has_text, "text"),
    ).withColumn("reject_reason", F.when(~has_image & ~has_text, "image or text required"))


def normalize_products(raw: DataFrame) -> DataFrame:
    """Stripped name, blank brand and description dropped, slug category, price to two decimals."""
    return raw.select(
        "product_id",
        strip(F.col("name")).alias("name"),
        blank_to_null(F.col("brand")).alias("brand"),
        facet_key(F.col("category")).alias("category"),
        blank_to_null(F.col("description")).alias("description"),
        rounded(F.col("price"), 2).alias("price"),
        facet_key(F.col("brand")).alias("brand_key"),
        facet_key(F.col("category")).alias("category_key"),
    )


# Longest accepted name, brand, description and category.
MAX_LENGTHS = {"name": 200, "brand": 100, "description": 2000, "category": 100}


def reject_reason() -> Column:
    """First broken rule of a product row, null when it is acceptable."""
    reason = F.when(blank_to_null(F.col("name")).isNull(), "name is blank")
    reason = reason.when(F.col("price") < 0, "price is negative")
    for column, limit in MAX_LENGTHS.items():
        reason = reason.when(F.length(column) > limit, f"{column} is too long")
    return reason


def split_rejected(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reject_reason``)."""
    checked = products.withColumn("reject_reason", reject_reason())
    return (checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            checked.filter(F.col("reject_reason").isNotNull()))


def check_files(files: DataFrame, cfg: IntakeConfig = DEFAULTS.intake) -> DataFrame:
    """Adds ``reject_reason`` to a file listing with extension, mime_type and size_bytes."""
    return files.withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.lower("extension").isin(*cfg.extensions), F.lit(False)), "extension")
        .when(~F.coalesce(F.col("mime_type").isin(*cfg.mime_types), F.lit(False)), "mime type")
        .when(F.col("size_bytes") > cfg.max_bytes, "too large"),
    )


def check_images(images: DataFrame, cfg: IntakeConfig = DEFAULTS.intake) -> DataFrame:
    """Adds ``reject_reason`` to rows with format, width and height."""
    side = F.greatest("width", "height")
    return images.withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.upper("format").isin(*cfg.image_formats), F.lit(False)), "format")
        .when(side > cfg.max_dimension_px, "dimensions"),
    )


def recommendation_view(recs: DataFrame, *, shared_brand: bool = False, shared_category: bool = False,
                        has_attributes: bool = False, min_score: float = 0.0) -> DataFrame:
    """The overlap filters of the recommendation list."""
    out = recs.filter(F.col("final_score") >= min_score)
    if shared_brand:
        out = out.filter("shared_brand")
    if shared_category:
        out = out.filter("shared_category")
    if has_attributes:
        out = out.filter(F.size("matched_attributes") > 0)
    return out


def recommendation_order(key: str, descending: bool = True) -> list[Column]:
    """Sort keys of the recommendation list: score, attributes or tags."""
    column = {"score": F.col("final_score"), "attributes": F.size("matched_attributes"),
              "tags": F.size("shared_tags")}[key]
    return [column.desc() if descending else column.asc(), F.col("product_id").asc()]


def result_order(key: str, descending: bool = False) -> list[Column]:
    """Sort keys of a result list; a missing price counts as infinitely high."""
    if key == "relevance":
        column = F.col("score")
    elif key == "price":
        column = F.coalesce(F.col("price"), F.lit(float("inf")))
    else:
        column = F.coalesce(F.col("name"), F.lit(""))
    return [column.desc() if descending else column.asc(), F.col("product_id").asc()]


def audit_view(events: DataFrame, *, action: str | None = None, actor: str | None = None) -> DataFrame:
    """Exact action, actor containing the text ignoring case; blank conditions filter nothing."""
    out = events
    if action:
        out = out.filter(F.col("action") == action)
    if actor and actor.strip():
        out = out.filter(F.lower("actor").contains(actor.strip().lower()))
    return out


def subset(queries: DataFrame, *, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Evaluation subset: the named ids first, then the first ``limit`` by position."""
    out = queries if ids is None else queries.filter(F.col("query_id").isin(ids))
    return out if limit is None else out.orderBy("position").limit(limit)
