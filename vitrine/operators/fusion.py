"""Two-modality score fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, SearchConfig
from vitrine.functions.scalars import rank_value
from vitrine.operators.neighbors import top_k


def fuse(image_hits: DataFrame, text_hits: DataFrame, cfg: SearchConfig = DEFAULTS.search) -> DataFrame:
    """Full outer merge of both top-k lists; a missing side scores 0."""
    image = image_hits.select("query_id", "product_id", F.col("score").alias("image_score"))
    text = text_hits.select("query_id", "product_id", F.col("score").alias("text_score"))
    both = image.join(text, ["query_id", "product_id"], "full_outer")
    modalities = F.array_compact(F.array(
        F.when(F.col("image_score").isNotNull(), "image"),
        F.when(F.col("text_score").isNotNull(), "text")))
    return both.withColumn("matched_modalities", modalities).withColumns({
        "image_score": F.coalesce("image_score", F.lit(0.0)),
        "text_score": F.coalesce("text_score", F.lit(0.0)),
    }).withColumn(
        "score", cfg.image_weight * F.col("image_score") + cfg.text_weight * F.col("text_score"))


def single_modality(hits: DataFrame, modality: str) -> DataFrame:
    """Hits of one modality in the fused shape; the score stays unweighted."""
    zero = F.lit(0.0)
    return hits.select(
        "query_id", "product_id", F.col("score"),
        (F.col("score") if modality == "image" else zero).alias("image_score"),
        (F.col("score") if modality == "text" else zero).alias("text_score"),
        F.array(F.lit(modality)).alias("matched_modalities"),
    )


def ranked(fused: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best per query with their 1-based rank."""
    return top_k(fused.withColumn("_by", rank_value(F.col(score))), k, by="_by").drop("_by")
