"""Explanation traces: what a decision was built from, in one uniform shape.

Every trace has decision_type, subject_id, summary, reasons (code, description, weight),
components (name, value, weight, contribution), total and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, RecommendConfig, SearchConfig
from vitrine.functions.scalars import percent, summary_sentence


def _component(name: str, value: Column, weight: float) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(weight).alias("weight"),
                    (value * weight).alias("contribution"))


def _reason(code: str, description: Column, weight: Column | None = None) -> Column:
    weight = F.lit(None).cast("double") if weight is None else weight
    return F.struct(F.lit(code).alias("code"), description.alias("description"),
                    weight.alias("weight"))


def _trace(df: DataFrame, keys: list[str], kind: str, lead: Column | str, subject: Column,
           reasons: Column, components: Column, total: Column) -> DataFrame:
    staged = df.withColumns({"_reasons": reasons, "_components": components})
    described = F.transform("_reasons", lambda r: r["description"])
    return staged.select(
        *keys, F.lit(kind).alias("decision_type"), subject.cast("string").alias("subject_id"),
        summary_sentence(lead, described).alias("summary"), F.col("_reasons").alias("reasons"),
        F.col("_components").alias("components"), total.alias("total"), total.alias("confidence"))


def explain_hybrid(hits: DataFrame, cfg: SearchConfig = DEFAULTS.search) -> DataFrame:
    image, text = F.col("image_score"), F.col("text_score")
    reasons = F.array(
        _reason("image_similarity", F.concat(percent(image), F.lit(" image similarity")),
                F.lit(cfg.image_weight)),
        _reason("text_similarity", F.concat(percent(text), F.lit(" text similarity")),
                F.lit(cfg.text_weight)))
    parts = F.array(_component("image_similarity", image, cfg.image_weight),
                    _component("text_similarity", text, cfg.text_weight))
    return _trace(hits, ["query_id", "product_id"], "hybrid_search", "Ranked by hybrid similarity",
                  F.col("product_id"), reasons, parts, F.col("score"))


def explain_rerank(reranked: DataFrame) -> DataFrame:
    score = F.col("rerank_score")
    reasons = F.array(
        _reason("cross_encoder_score", F.concat(F.lit("cross-encoder relevance "), percent(score)),
                score),
        _reason("rank_movement", F.col("explanation")))
    parts = F.array(_component("original_score", F.col("score"), 1.0),
                    _component("cross_encoder_score", score, 1.0))
    return _trace(reranked, ["query_id", "product_id"], "reranking", "Reranked by cross-encoder",
                  F.col("product_id"), reasons, parts, score)


def explain_duplicate(verdicts: DataFrame) -> DataFrame:
    reasons = F.transform("reasons", lambda r: F.struct(
        r["code"].alias("code"), r["message"].alias("description"),
        F.lit(None).cast("double").alias("weight")))
    ce, near = F.col("cross_encoder_score"), F.col("retrieval_similarity")
    parts = F.array_compact(F.array(
        F.when(ce.isNotNull(), _component("cross_encoder_score", ce, 1.0)),
        F.when(near.isNotNull(), _component("retrieval_similarity", near, 1.0))))
    lead = F.when(F.col("is_duplicate"), "Judged a duplicate because").otherwise(
        "Not a duplicate because")
    out = _trace(verdicts, ["query_id"], "duplicate", lead, F.col("matched_product"), reasons, parts,
                 F.col("confidence"))
    return out.withColumn("total", F.when(F.size("components") > 0, F.col("total")))


def explain_recommendation(recs: DataFrame, cfg: RecommendConfig = DEFAULTS.recommend) -> DataFrame:
    reasons = F.array_compact(F.array(
        F.when(F.col("shared_brand"), _reason("shared_brand", F.lit("the same brand"))),
        F.when(F.col("shared_category"), _reason("shared_category", F.lit("the same category"))),
        F.when(F.size("matched_attributes") > 0, _reason("matched_attributes", F.concat(
            F.lit("matching "), F.array_join("matched_attributes", ", ")))),
        F.when(F.size("shared_tags") > 0, _reason("shared_tags", F.concat(
            F.lit("shared tags ("), F.array_join("shared_tags", ", "), F.lit(")"))))))
    parts = F.array(
        _component("similarity", F.col("similarity_score"), cfg.similarity_weight),
        _component("attribute_match", F.col("attribute_score"), cfg.attribute_weight),
        _component("tag_match", F.col("tag_score"), cfg.tag_weight),
        _component("quality", F.col("quality_score"), cfg.quality_weight))
    return _trace(recs, ["query_id", "product_id"], "recommendation",
                  "Recommended because it shares", F.col("product_id"), reasons, parts,
                  F.col("final_score"))


def combined(duplicates: DataFrame, recommendations: DataFrame) -> DataFrame:
    """All traces about a product: its duplicate verdict, then its recommendations."""
    shape = ["query_id", "decision_type", "subject_id", "summary", "reasons", "components", "total",
             "confidence"]
    return duplicates.select(*shape).unionByName(recommendations.select(*shape))
