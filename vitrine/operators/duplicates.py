"""Duplicate scoring, decisions, business rules and verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, DuplicateConfig, VerifyConfig
from vitrine.functions.fuzzy import ratio_bound, token_similarities
from vitrine.functions.scalars import (
    blank_to_null, clamp01, fixed, fold, mean_of_present, percent, rank_value)
from vitrine.operators.pairs import pair_up, with_letters, with_tokens

METADATA_FIELDS = ("name", "brand", "category")
ATTRIBUTE_FIELDS = ("brand", "category", "color", "material", "style", "gender")
FUZZY_FIELDS = ["name", "brand", "category", "color", "material", "style", "gender"]
OVERLAP_FIELDS = ("color", "material", "gender", "style")


def _fuzzy_pairs(hits: DataFrame, targets: DataFrame, candidates: DataFrame, fields: list[str],
                 extra: list[str], likely: Column | None = None) -> DataFrame:
    """Hits with ``sim_<field>`` for each field (null when missing on either side).

    ``likely`` is a condition on the ``tok_`` and ``abc_`` columns that pairs worth comparing meet.
    """
    columns = [f"tok_{f}" for f in fields] + extra
    same = targets is candidates
    prepare = with_tokens if likely is None else lambda df, names: with_letters(with_tokens(df, names), names)
    columns += [] if likely is None else [f"abc_{f}" for f in fields]
    targets = prepare(targets, fields)
    candidates = targets if same else prepare(candidates, fields)
    paired = pair_up(hits, targets, candidates, columns)
    if likely is not None:
        paired = paired.filter(likely)
    found = token_similarities({f: (F.col(f"t_tok_{f}"), F.col(f"c_tok_{f}")) for f in fields})
    paired = paired.withColumn("_sim", found)
    return paired.withColumns({f"sim_{f}": F.col("_sim")[f] for f in fields}).drop("_sim")


def _total(image: Column, text: Column, metadata: Column, attributes: Column, cfg: DuplicateConfig) -> Column:
    return clamp01(cfg.image_weight * image + cfg.text_weight * text + cfg.metadata_weight * metadata
                   + cfg.attribute_weight * attributes)


def _may_reach(limit: float, cfg: DuplicateConfig) -> Column:
    """Whether the letters that a pair's fields share leave room for ``limit``."""
    bound = {f: ratio_bound(*(F.col(f"{side}_{kind}_{f}") for kind in ("tok", "abc") for side in "tc")) for f in FUZZY_FIELDS}
    most = _total(clamp01(F.col("image_score")), clamp01(F.col("text_score")),
                  mean_of_present(*[bound[f] for f in METADATA_FIELDS]),
                  mean_of_present(*[bound[f] for f in ATTRIBUTE_FIELDS]), cfg)
    return most >= limit - 1e-9


def score_pairs(hits: DataFrame, targets: DataFrame, candidates: DataFrame,
                cfg: DuplicateConfig = DEFAULTS.duplicate, at_least: float | None = None) -> DataFrame:
    """Four weighted signals and their clamped sum per hit.

    ``targets`` describes the checked products by ``product_id`` = query id. With ``at_least`` only pairs that reach it
    are returned, and fields are compared only where their letters leave room for it.
    """
    scored = _fuzzy_pairs(
        hits.select("query_id", "product_id", "image_score", "text_score"),
        targets, candidates, FUZZY_FIELDS, [], None if at_least is None else _may_reach(at_least, cfg))
    scored = scored.select(
        "query_id", "product_id",
        clamp01(F.col("image_score")).alias("image_signal"),
        clamp01(F.col("text_score")).alias("text_signal"),
        mean_of_present(*[F.col(f"sim_{f}") for f in METADATA_FIELDS]).alias("metadata_signal"),
        mean_of_present(*[F.col(f"sim_{f}") for f in ATTRIBUTE_FIELDS]).alias("attribute_signal"),
    )
    scored = scored.withColumn("overall_similarity", _total(
        *(F.col(f"{s}_signal") for s in ("image", "text", "metadata", "attribute")), cfg))
    return scored if at_least is None else scored.filter(rank_value(F.col("overall_similarity")) >= at_least)


def decide(subjects: DataFrame, scored: DataFrame,
           cfg: DuplicateConfig = DEFAULTS.duplicate) -> DataFrame:
    """One decision per subject from its best-scored candidate."""
    candidate = F.struct((-rank_value(F.col("overall_similarity"))).alias("order"), "product_id",
                         "overall_similarity")
    per_subject = scored.groupBy("query_id").agg(
        F.array_sort(F.collect_list(candidate)).alias("_ranked"))
    out = subjects.select("query_id").join(per_subject, "query_id", "left")
    best = F.col("_ranked")[0]
    confidence = F.coalesce(best["overall_similarity"], F.lit(0.0))
    hit = F.coalesce(rank_value(confidence) >= cfg.threshold, F.lit(False)) & best.isNotNull()
    limit = fixed(F.lit(cfg.threshold), 2)
    reason = (
        F.when(best.isNull(), "No candidates were found to compare against.")
        .when(hit, F.concat(F.lit("Overall similarity "), fixed(confidence, 2),
                            F.lit(" meets or exceeds the "), limit, F.lit(" threshold.")))
        .otherwise(F.concat(F.lit("Best candidate similarity "), fixed(confidence, 2),
                            F.lit(" is below the "), limit, F.lit(" threshold.")))
    )
    return out.select(
        "query_id", hit.alias("is_duplicate"), confidence.alias("confidence"),
        F.when(hit, best["product_id"]).alias("matched_product"), reason.alias("reason"),
        F.transform("_ranked", lambda c: F.struct(
            c["product_id"].alias("product_id"),
            c["overall_similarity"].alias("similarity"))).alias("top_candidates"),
    )


def gate(products: DataFrame, decisions: DataFrame, mode: str) -> DataFrame:
    """What ingest lets through: off ignores decisions, warn attaches them, block drops duplicates."""
    if mode not in ("off", "warn", "block"):
        raise ValueError(f"unknown duplicate mode {mode!r}")
    flags = decisions.select(F.col("query_id").alias("product_id"), "is_duplicate",
                             "matched_product", "confidence")
    if mode == "off":
        return products.withColumns({
            "is_duplicate": F.lit(False),
            "matched_product": F.lit(None).cast(flags.schema["matched_product"].dataType),
            "confidence": F.lit(0.0)})
    joined = products.join(flags, "product_id", "left").na.fill(
        {"is_duplicate": False, "confidence": 0.0})
    return joined if mode == "warn" else joined.filter(~F.col("is_duplicate"))


def _rule(applicable: Column, ok: Column, good: tuple, bad: tuple, name: str) -> Column:
    def side(code: str, message: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.lit(code).alias("code"),
                        message.alias("message"), F.lit(code == good[0]).alias("satisfied"))

    return F.when(applicable & ok, side(*good)).when(applicable, side(*bad))


def business_rules(cfg: VerifyConfig = DEFAULTS.verify) -> Column:
    """Applicable rules in order as (rule, code, message, satisfied); needs ``t_``/``c_`` payload
    columns and ``sim_name``/``sim_category``."""
    tb, cb = F.col("t_brand"), F.col("c_brand")
    brand = _rule(
        fold(tb).isNotNull() & fold(cb).isNotNull(), fold(tb) == fold(cb),
        ("same_brand", F.concat(F.lit("Same brand ("), tb, F.lit(")"))),
        ("brand_mismatch", F.concat(F.lit("Different brand ("), tb, F.lit(" vs "), cb, F.lit(")"))),
        "brand")
    tc, cc = F.col("t_category"), F.col("c_category")
    category = _rule(
        F.col("sim_category").isNotNull(), F.col("sim_category") >= cfg.category_match_ratio,
        ("same_category", F.concat(F.lit("Same category ("), tc, F.lit(")"))),
        ("category_mismatch",
         F.concat(F.lit("Different category ("), tc, F.lit(" vs "), cc, F.lit(")"))),
        "category")
    gap = F.abs(F.col("t_price") - F.col("c_price")) / F.greatest(F.abs("c_price"), F.lit(1e-9))
    price = _rule(
        gap.isNotNull(), gap <= cfg.max_price_difference_ratio,
        ("close_price", F.concat(F.lit("Similar price (within "), percent(gap), F.lit(")"))),
        ("price_difference", F.concat(F.lit("Price differs by "), percent(gap))),
        "price")
    likeness = F.coalesce("sim_name", F.lit(0.0))
    title = _rule(
        blank_to_null(F.col("c_name")).isNotNull(), likeness >= cfg.title_similarity_threshold,
        ("title_similarity", F.concat(F.lit("Title similarity "), percent(likeness))),
        ("title_difference", F.concat(F.lit("Title similarity only "), percent(likeness))),
        "title")
    present = [fold(F.col(f"t_{f}")).isNotNull() & fold(F.col(f"c_{f}")).isNotNull()
               for f in OVERLAP_FIELDS]
    equal = F.array_compact(F.array(*[
        F.when(F.coalesce(fold(F.col(f"t_{f}")) == fold(F.col(f"c_{f}")), F.lit(False)), F.lit(f))
        for f in OVERLAP_FIELDS]))
    overlap = _rule(
        reduce(lambda a, b: a | b, present), F.size(equal) > 0,
        ("attribute_overlap", F.concat(F.lit("Matching attributes: "), F.array_join(equal, ", "))),
        ("attribute_mismatch", F.lit("No matching attributes")),
        "attributes")
    return F.array_compact(F.array(brand, category, price, title, overlap))


def apply_rules(pairs: DataFrame, targets: DataFrame, candidates: DataFrame,
                cfg: VerifyConfig = DEFAULTS.verify) -> DataFrame:
    """Pairs with ``rules``, ``rule_score`` (satisfied over applicable) and ``veto``."""
    payload = ["name", "brand", "category", "price", *OVERLAP_FIELDS]
    paired = _fuzzy_pairs(pairs, targets, candidates, ["name", "category"], payload)
    checked = paired.withColumn("rules", business_rules(cfg))
    satisfied = F.size(F.filter("rules", lambda r: r["satisfied"])).cast("double")
    vetoing = [n for n, on in (("brand", cfg.require_same_brand),
                               ("category", cfg.require_same_category)) if on]
    veto = F.exists("rules", lambda r: r["rule"].isin(*vetoing) & ~r["satisfied"]) if vetoing \
        else F.lit(False)
    return checked.select(
        *pairs.columns, "rules",
        F.coalesce(F.try_divide(satisfied, F.size("rules").cast("double")), F.lit(0.0))
        .alias("rule_score"), veto.alias("veto"))


def verify(subjects: DataFrame, reranked: DataFrame, targets: DataFrame, candidates: DataFrame,
           cfg: VerifyConfig = DEFAULTS.verify) -> DataFrame:
    """Verdict per subject from its best reranked candidate and the business rules."""
    best = reranked.filter(F.col("final_rank") == 1).select(
        "query_id", "product_id", F.col("rerank_score").alias("cross_encoder_score"),
        F.col("score").alias("retrieval_similarity"))
    ruled = apply_rules(best, targets, candidates, cfg)
    joined = subjects.select("query_id").join(ruled, "query_id", "left")
    ce = F.col("cross_encoder_score")
    meets = rank_value(ce) >= cfg.cross_encoder_threshold
    none_found = F.col("product_id").isNull()
    first = F.struct(F.lit("cross_encoder").alias("code"), F.concat(
        F.lit("Cross-encoder relevance "), fixed(ce, 2), F.when(meets, " meets").otherwise(" is below"),
        F.lit(" the "), fixed(F.lit(cfg.cross_encoder_threshold), 2), F.lit(" threshold.")
    ).alias("message"))
    rest = F.transform("rules", lambda r: F.struct(
        r["code"].alias("code"), r["message"].alias("message")))
    nothing = F.array(F.struct(
        F.lit("no_candidates").alias("code"),
        F.lit("No existing products were found to compare against.").alias("message")))
    return joined.select(
        "query_id",
        F.coalesce(meets & ~F.col("veto"), F.lit(False)).alias("is_duplicate"),
        F.coalesce(cfg.cross_encoder_weight * ce + cfg.business_rules_weight * F.col("rule_score"),
                   F.lit(0.0)).alias("confidence"),
        "cross_encoder_score", "retrieval_similarity",
        F.col("product_id").alias("matched_product"),
        F.when(none_found, nothing).otherwise(F.concat(F.array(first), rest)).alias("reasons"),
    )


def as_verification(decisions: DataFrame) -> DataFrame:
    """A weighted decision in the shape ``verify`` returns, without second-stage scores."""
    reason = F.when(F.col("reason") != "", F.array(F.struct(
        F.lit("weighted_similarity").alias("code"), F.col("reason").alias("message"))))
    none = F.lit(None).cast("double")
    return decisions.select(
        "query_id", "is_duplicate", "confidence", none.alias("cross_encoder_score"),
        none.alias("retrieval_similarity"), "matched_product",
        F.coalesce(reason, F.array().cast("array<struct<code:string,message:string>>"))
        .alias("reasons"))
