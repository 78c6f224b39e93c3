"""Attributes and tags from product text, merged with other sources and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, EnrichConfig
from vitrine.functions import keywords as K
from vitrine.functions.scalars import blank_to_null, clamp01, fold, strip


def _combined_text():
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit(""))
                              for c in ("name", "category", "description")])


def _text_rows(products: DataFrame) -> DataFrame:
    """Products with all attribute predictions in one array, in rule order."""
    rows = []
    for attribute, dictionary, confidence in K.ATTRIBUTE_RULES:
        value = K.first_value(F.col("_hits"), dictionary)
        score = F.lit(confidence)
        if attribute in ("brand", "category"):
            submitted = F.nullif(F.col(attribute), F.lit(""))
            score = F.when(submitted.isNotNull(), K.SUBMITTED_CONFIDENCE).otherwise(confidence)
            value = F.coalesce(submitted, value)
        rows.append(F.struct(F.lit(attribute).alias("attribute"), value.alias("value"),
                             score.alias("confidence")))
    with_text = products.withColumn("_hits", K.keyword_hits(_combined_text()))
    found = F.filter(F.array(*rows), lambda p: p["value"].isNotNull())
    return with_text.withColumn("_predictions", found)


def text_attributes(products: DataFrame) -> DataFrame:
    """(product_id, attribute, value, confidence, source): one row per attribute found in the text."""
    # The outer form keeps the optimizer from testing the array, and so the text, a second time.
    rows = _text_rows(products).select("product_id", F.explode_outer("_predictions").alias("p"))
    return rows.filter(F.col("p").isNotNull()).select("product_id", "p.*", F.lit("text").alias("source"))


def _tags_of(dictionary: dict[str, str], confidence: float) -> Column:
    return F.transform(K.all_values(F.col("_hits"), dictionary), lambda v: F.struct(
        F.lower(v).alias("tag"), F.lit(confidence).alias("confidence")))


def text_tags(products: DataFrame) -> DataFrame:
    """(product_id, tag, confidence, source, position): attribute values, every color, material and
    style, and descriptor words; the first of equal tags stays."""
    base = _text_rows(products)
    parts = [F.transform("_predictions", lambda p: F.struct(
        F.lower(strip(p["value"])).alias("tag"), p["confidence"].alias("confidence")))]
    for attribute, dictionary, confidence in K.ATTRIBUTE_RULES:
        if attribute in ("color", "material", "style"):
            parts.append(_tags_of(dictionary, confidence))
    parts.append(_tags_of({w: w for w in sorted(K.DESCRIPTORS)}, K.DESCRIPTOR_CONFIDENCE))
    tags = base.select("product_id", F.posexplode_outer(F.concat(*parts)).alias("position", "t"))
    first = tags.filter(F.col("t").isNotNull()).groupBy("product_id", F.col("t.tag").alias("tag")).agg(
        F.min(F.struct("position", "t.confidence")).alias("f"))
    return first.select("product_id", "tag", "f.confidence", F.lit("text").alias("source"),
                        "f.position")


def merge_attributes(predictions: DataFrame, cfg: EnrichConfig = DEFAULTS.enrich) -> DataFrame:
    """Per product and attribute the most confident value (text wins ties), whether sources
    disagreed, and whether it clears the confidence gate."""
    order = F.struct(F.col("confidence"), (F.col("source") == "text").cast("int"))
    merged = predictions.groupBy("product_id", "attribute").agg(
        F.max_by(F.struct("value", "confidence", "source"), order).alias("w"),
        (F.min("value") != F.max("value")).alias("conflict"),
    )
    return merged.select("product_id", "attribute", "w.*", "conflict",
                         (F.col("w.confidence") >= cfg.confidence_threshold).alias("accepted"))


def attribute_columns(merged: DataFrame) -> DataFrame:
    """One row per product: its accepted attributes, their mean confidence and the conflict counts."""
    value = {a: F.max(F.when(F.col("accepted") & (F.col("attribute") == a), F.col("value"))).alias(a)
             for a in K.ATTRIBUTE_FIELDS}
    return merged.groupBy("product_id").agg(
        *value.values(),
        F.coalesce(F.avg(F.when(F.col("accepted"), F.col("confidence"))), F.lit(0.0))
        .alias("confidence"),
        F.count_if("accepted").alias("filled"),
        F.count_if("conflict").alias("conflicts"),
        F.count("*").alias("considered"),
    )


def merge_tags(tags: DataFrame, cfg: EnrichConfig = DEFAULTS.enrich) -> DataFrame:
    """Per product the accepted tags, most confident first, at most ``max_tags``.

    ``tags`` carries ``position``, its place in text-then-image order.
    """
    keyed = tags.withColumn("tag", fold(F.col("tag"))).filter(F.col("tag").isNotNull())
    merged = keyed.groupBy("product_id", "tag").agg(
        F.max("confidence").alias("confidence"),
        F.when(F.min("source") != F.max("source"), "hybrid").otherwise(F.min("source"))
        .alias("source"),
        F.min("position").alias("position"),
    ).filter(F.col("confidence") >= cfg.confidence_threshold)
    order = Window.partitionBy("product_id").orderBy(F.col("confidence").desc(), "position", "tag")
    return merged.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= cfg.max_tags).drop("position")


def quality_score(attributes: DataFrame, cfg: EnrichConfig = DEFAULTS.enrich) -> DataFrame:
    """Adds ``quality_score`` to ``attribute_columns`` rows."""
    completeness = F.col("filled") / F.lit(float(len(K.ATTRIBUTE_FIELDS)))
    consistency = 1.0 - F.coalesce(F.try_divide(
        F.col("conflicts").cast("double"), F.col("considered").cast("double")), F.lit(0.0))
    return attributes.withColumn("quality_score", clamp01(
        cfg.completeness_weight * completeness
        + cfg.confidence_weight * F.col("confidence")
        + cfg.consistency_weight * consistency))


def enrich(products: DataFrame, image_predictions: DataFrame | None = None,
           image_tags: DataFrame | None = None, cfg: EnrichConfig = DEFAULTS.enrich) -> DataFrame:
    """Products with merged attributes, tags and quality; a product without any signal keeps a row."""
    predictions = text_attributes(products)
    if image_predictions is not None:
        predictions = predictions.unionByName(image_predictions)
    tags = text_tags(products)
    if image_tags is not None:
        tags = tags.unionByName(image_tags)
    attributes = attribute_columns(merge_attributes(predictions, cfg))
    tag_rows = F.struct(F.col("rank"), "tag", "confidence", "source")
    listed = merge_tags(tags, cfg).groupBy("product_id").agg(
        F.array_sort(F.collect_list(tag_rows)).alias("_tags"))
    ids = products.select("product_id")
    joined = ids.join(attributes, "product_id", "left").na.fill(
        0, ["filled", "conflicts", "considered"]).na.fill(0.0, ["confidence"])
    scored = quality_score(joined, cfg).join(listed, "product_id", "left")
    return scored.withColumn("tags", F.coalesce(
        F.transform("_tags", lambda t: t["tag"]), F.array().cast("array<string>"))).drop("_tags")


def payload(normalized: DataFrame, enriched: DataFrame) -> DataFrame:
    """Stored product payload: normalized fields plus enrichment, submitted values first."""
    extra = enriched.select(
        "product_id", *[F.col(a).alias(f"_{a}") for a in ("color", "material", "gender", "season",
                                                         "style")], "tags", "quality_score")
    joined = normalized.join(extra, "product_id", "left")
    return joined.select(
        *[c for c in normalized.columns],
        *[blank_to_null(F.col(f"_{a}")).alias(a)
          for a in ("color", "material", "gender", "season", "style")],
        "tags", "quality_score")
