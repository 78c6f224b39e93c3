"""Price estimates from comparable products.

A subject has at most top-k comparables (20 by default), so its prices fit one array and the
whole estimate is one aggregation followed by array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, PricingConfig
from vitrine.functions.scalars import clamp01, fixed, fold, positive_price, rounded


def comparables(hits: DataFrame, products: DataFrame) -> DataFrame:
    """Priced hits: (subject_id, product_id, price, similarity, category)."""
    payload = products.select("product_id", positive_price(F.col("price")).alias("price"), "category")
    return (
        hits.select(F.col("query_id").alias("subject_id"), "product_id",
                    F.col("score").alias("similarity"))
        .join(payload.filter(F.col("price").isNotNull()), "product_id")
        .select("subject_id", "product_id", "price", "similarity", "category")
    )


def judge(comps: DataFrame, subjects: DataFrame, cfg: PricingConfig = DEFAULTS.pricing) -> DataFrame:
    """Adds ``outcome``: kept, category or similarity; the category rule needs a known subject."""
    own = subjects.select("subject_id", fold(F.col("category")).alias("subject_category"))
    judged = comps.join(own, "subject_id")
    enforce = F.col("subject_category").isNotNull() & F.lit(cfg.restrict_to_same_category)
    other = enforce & ~F.coalesce(fold(F.col("category")) == F.col("subject_category"), F.lit(False))
    return judged.withColumn(
        "outcome",
        F.when(other, "category").when(F.col("similarity") < cfg.min_similarity, "similarity")
        .otherwise("kept"),
    )


def outcome_counts(judged: DataFrame) -> DataFrame:
    """How many comparables each rule excluded and how many stayed."""
    return judged.groupBy("subject_id").agg(
        F.count_if(F.col("outcome") == "category").alias("excluded_by_category"),
        F.count_if(F.col("outcome") == "similarity").alias("excluded_by_similarity"),
        F.count_if(F.col("outcome") == "kept").alias("kept"),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean(values: Column) -> Column:
    return F.try_divide(_total(values), F.size(values).cast("double"))


def exclusive_quartile(prices: Column, n: Column, i: int) -> Column:
    """Quartile ``i`` of ``n`` sorted values by the exclusive method; null below two values."""
    j = F.greatest(F.lit(1), F.least((i * (n + 1) / 4).cast("int"), n - 1))
    delta = (i * (n + 1) - j * 4).cast("double")
    low, high = F.try_element_at(prices, j), F.try_element_at(prices, j + 1)
    return (low * (4 - delta) + high * delta) / 4.0


def without_outliers(frame: DataFrame, cfg: PricingConfig) -> DataFrame:
    """Adds ``_used``: the entries of ``_kept`` (sorted by price) inside the Tukey fence."""
    if cfg.outlier_iqr_multiplier <= 0:
        return frame.withColumn("_used", F.col("_kept"))
    staged = frame.withColumns({"_prices": F.transform("_kept", lambda c: c["price"]),
                                "_n": F.size("_kept")})
    staged = staged.withColumns({f"_q{i}": exclusive_quartile(F.col("_prices"), F.col("_n"), i)
                                 for i in (1, 3)})
    reach = cfg.outlier_iqr_multiplier * (F.col("_q3") - F.col("_q1"))
    staged = staged.withColumns({"_low": F.col("_q1") - reach, "_high": F.col("_q3") + reach})
    inside = F.filter("_kept", lambda c: c["price"].between(F.col("_low"), F.col("_high")))
    used = F.when(F.col("_n") < cfg.min_for_outliers, F.col("_kept")).otherwise(inside)
    return staged.withColumn("_used", used).drop("_prices", "_n", "_q1", "_q3", "_low", "_high")


def median_price(prices: Column) -> Column:
    n = F.size(prices)
    upper = F.try_element_at(prices, (n / 2).cast("int") + 1)
    lower = F.try_element_at(prices, F.greatest((n / 2).cast("int"), F.lit(1)))
    return F.when(n % 2 == 1, upper).otherwise((lower + upper) / 2.0)


def weighted_price(kept: Column) -> Column:
    """Mean weighted by similarity, or the plain mean when no weight is positive."""
    def weight(c: Column) -> Column:
        return F.greatest(c["similarity"], F.lit(0.0))

    total = F.aggregate(kept, F.lit(0.0), lambda s, c: s + weight(c))
    value = F.aggregate(kept, F.lit(0.0), lambda s, c: s + c["price"] * weight(c))
    return F.when(total > 0, value / total).otherwise(_mean(F.transform(kept, lambda c: c["price"])))


def trimmed_price(prices: Column, ratio: float) -> Column:
    """Mean without the lowest and highest ``ratio`` of the values; all of them if none would stay."""
    n = F.size(prices)
    cut = F.floor(n * F.lit(ratio)).cast("int")
    rest = F.slice(prices, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))
    return F.coalesce(F.when(F.size(rest) > 0, _mean(rest)), _mean(prices))


def _strategy_price(kept: Column, prices: Column, strategy: str, cfg: PricingConfig) -> Column:
    if strategy == "median":
        return median_price(prices)
    if strategy == "weighted_average":
        return weighted_price(kept)
    return trimmed_price(prices, cfg.trim_ratio)


def confidence_score(prices: Column, mean: Column, cfg: PricingConfig) -> Column:
    """Count factor times price agreement, to three decimals; ``mean`` is the mean of ``prices``."""
    n = F.size(prices)
    spread = F.sqrt(_mean(F.transform(prices, lambda p: (p - mean) * (p - mean))))
    variation = F.when((n > 1) & (mean > 0), F.try_divide(spread, mean)).otherwise(0.0)
    enough = F.least(n / F.lit(cfg.min_comparables * 2.0), F.lit(1.0))
    return rounded(enough * F.greatest(F.lit(0.0), 1.0 - variation), 3)


def confidence_band(count: Column, score: Column, cfg: PricingConfig) -> Column:
    return (
        F.when(count < cfg.min_comparables, "low")
        .when(score >= cfg.high_score, "high")
        .when(score >= cfg.medium_score, "medium")
        .otherwise("low")
    )


def _exclusions(cfg: PricingConfig) -> Column:
    """What the relevance rules dropped, as text; empty when nothing was."""
    by_category, by_similarity = F.col("excluded_by_category"), F.col("excluded_by_similarity")
    scope = F.coalesce(F.concat(F.lit(" (not "), F.col("subject_category"), F.lit(")")), F.lit(""))
    if not cfg.restrict_to_same_category:
        scope = F.lit("")
    category_part = F.when(by_category > 0, F.concat(
        by_category.cast("string"), F.lit(" from other categories"), scope))
    similarity_part = F.when(by_similarity > 0, F.concat(
        by_similarity.cast("string"), F.lit(" below the "), fixed(F.lit(cfg.min_similarity), 2),
        F.lit(" similarity floor")))
    text = F.concat_ws(" and ", category_part, similarity_part)
    return F.when(text == "", "").otherwise(F.concat(F.lit("after excluding "), text))


def estimate(judged: DataFrame, subjects: DataFrame, cfg: PricingConfig = DEFAULTS.pricing,
             strategy: str | None = None) -> DataFrame:
    """One row per subject; without relevant comparables the price is null, never zero."""
    strategy = strategy or cfg.strategy
    piece = F.struct("price", "product_id", "similarity")
    per_subject = judged.groupBy("subject_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "kept", piece))).alias("_kept"),
        F.count_if(F.col("outcome") == "category").alias("excluded_by_category"),
        F.count_if(F.col("outcome") == "similarity").alias("excluded_by_similarity"),
        F.count_if(F.col("outcome") == "kept").alias("relevant_count"),
    )
    base = subjects.select("subject_id", fold(F.col("category")).alias("subject_category")).join(
        per_subject, "subject_id", "left")
    kind = per_subject.schema["_kept"].dataType
    base = base.withColumn("_kept", F.coalesce("_kept", F.array().cast(kind))).na.fill(
        0, ["excluded_by_category", "excluded_by_similarity", "relevant_count"])
    base = without_outliers(base, cfg).withColumns({
        "_prices": F.transform("_used", lambda c: c["price"]), "comparable_count": F.size("_used")})
    base = base.withColumn("_mean", _mean(F.col("_prices")))
    score = confidence_score(F.col("_prices"), F.col("_mean"), cfg)
    base = base.withColumns({
        "_price": _strategy_price(F.col("_used"), F.col("_prices"), strategy, cfg),
        "confidence_score": F.when(F.col("comparable_count") > 0, score).otherwise(0.0),
        "outliers_removed": F.col("relevant_count").cast("int") - F.col("comparable_count"),
        "_excluded": _exclusions(cfg),
    })
    band = confidence_band(F.col("comparable_count"), F.col("confidence_score"), cfg)
    base = base.withColumn("confidence", band)
    # Inside the fence lie at least the quartiles, so what was relevant never vanishes entirely.
    found = F.col("relevant_count") > 0
    built = F.concat(F.concat_ws(
        " ",
        F.format_string(f"Estimated from %d comparable product(s) using the {strategy} strategy",
                        F.col("comparable_count")),
        F.nullif(F.col("_excluded"), F.lit("")),
        F.when(F.col("outliers_removed") > 0, F.format_string(
            "after removing %d price outlier(s)", F.col("outliers_removed"))),
        F.concat(F.lit("("), F.col("confidence"), F.lit(" confidence)")),
    ), F.lit("."))
    refused = F.when(F.col("_excluded") == "", "No comparable priced products were found.").otherwise(
        F.concat(F.lit("No relevant comparable products remained "), F.col("_excluded"), F.lit(
            ". No price is estimated; a value drawn from unrelated products would be misleading.")))
    return base.select(
        "subject_id",
        F.when(found, rounded(F.col("_price"), 2)).alias("estimated_price"),
        F.when(found, "estimated").otherwise("no_estimate").alias("status"),
        "confidence", "confidence_score", F.lit(strategy).alias("strategy"), "comparable_count",
        "outliers_removed", "excluded_by_category", "excluded_by_similarity", "relevant_count",
        F.when(found, built).otherwise(refused).alias("reason"),
        F.col("_used").alias("comparables"),
    )


def price_spread(estimates: DataFrame) -> DataFrame:
    """Count, min, median, max and where the estimate lies between them; null when flat."""
    priced = estimates.filter("relevant_count > 0").select(
        "subject_id", "estimated_price", F.transform("comparables", lambda c: c["price"]).alias("_p"))
    priced = priced.select(
        "subject_id", "estimated_price", F.size("_p").alias("n"), F.array_min("_p").alias("min_price"),
        median_price(F.col("_p")).alias("median_price"), F.array_max("_p").alias("max_price"))
    width = F.col("max_price") - F.col("min_price")
    place = clamp01(F.try_divide(F.col("estimated_price") - F.col("min_price"), width))
    return priced.withColumn("estimate_position", F.when(width > 0, place)).drop("estimated_price")


def cheapest_first(estimates: DataFrame) -> DataFrame:
    """The comparables behind each estimate in price order."""
    rows = estimates.filter("relevant_count > 0").select(
        "subject_id", F.posexplode_outer("comparables").alias("position", "c"))
    return rows.select("subject_id", "position", "c.product_id", "c.price", "c.similarity")
