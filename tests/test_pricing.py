import random
import statistics
from dataclasses import replace

import pytest

from vitrine.config import DEFAULTS, PricingConfig
from vitrine.operators import pricing as P

NO_FENCE = replace(DEFAULTS.pricing, outlier_iqr_multiplier=0.0)


def run(spark, prices, strategy="median", cfg=DEFAULTS.pricing, similarity=None):
    similarity = similarity or [0.9] * len(prices)
    rows = [(1, i, float(p), float(s), "kept") for i, (p, s) in enumerate(zip(prices, similarity))]
    judged = spark.createDataFrame(
        rows, "subject_id long, product_id long, price double, similarity double, outcome string")
    subjects = spark.createDataFrame([(1, "bags")], "subject_id long, category string")
    return P.estimate(judged, subjects, cfg, strategy).first()


@pytest.mark.parametrize("prices, sims, strategy, cfg, expected", [
    ([10, 20, 300], None, "median", DEFAULTS.pricing, 20),
    ([100, 200], [0.9, 0.1], "weighted_average", DEFAULTS.pricing, 110),
    ([100, 200], [0, 0], "weighted_average", DEFAULTS.pricing, 150),
    ([1, 10, 12, 14, 1000], None, "trimmed_mean", replace(NO_FENCE, trim_ratio=0.2), 12),
    ([10, 20], None, "trimmed_mean", NO_FENCE, 15)])
def test_strategies(spark, prices, sims, strategy, cfg, expected):
    assert run(spark, prices, strategy, cfg, sims)["estimated_price"] == expected


def test_outliers(spark):
    row = run(spark, [*range(10, 20), 100000])
    assert (row["comparable_count"], row["outliers_removed"]) == (10, 1)
    assert "after removing 1 price outlier(s)" in row["reason"]
    assert run(spark, [10, 11, 100000])["comparable_count"] == 3


def test_no_comparables_is_no_price(spark):
    row = run(spark, [])
    assert row["estimated_price"] is None and row["status"] == "no_estimate"
    assert (row["confidence"], row["confidence_score"]) == ("low", 0.0)
    assert row["reason"] == "No comparable priced products were found."


@pytest.mark.parametrize("n, band", [(2, "low"), (4, "medium"), (6, "high")])
def test_confidence_by_count(spark, n, band):
    assert run(spark, [50] * n)["confidence"] == band


def test_spread_lowers_confidence(spark):
    row = run(spark, [10, 20, 30, 40, 50, 60], cfg=NO_FENCE)
    assert row["confidence"] == "medium" and row["confidence_score"] < 1


def test_quartiles_equal_the_exclusive_method(spark):
    rng = random.Random(4)
    cfg = PricingConfig(strategy="median")
    for n in (4, 5, 6, 7, 11, 20):
        prices = [rng.choice([5, 10, 11, 12, 200, 900]) + rng.random() for _ in range(n)]
        q1, _, q3 = statistics.quantiles(prices, n=4)
        kept = [p for p in prices if q1 - 1.5 * (q3 - q1) <= p <= q3 + 1.5 * (q3 - q1)]
        assert run(spark, prices, cfg=cfg)["comparable_count"] == len(kept)


def test_category_filter(spark):
    comps = spark.createDataFrame(
        [(1, i, 10.0, s, c) for i, (s, c) in enumerate(
            [(0.9, "  Footwear "), (0.8, "footwear")] + [(0.7, "kitchenware")] * 4 + [(0.9, None)])],
        "subject_id long, product_id long, price double, similarity double, category string")
    subjects = spark.createDataFrame([(1, "footwear")], "subject_id long, category string")
    row = P.outcome_counts(P.judge(comps, subjects)).first()
    assert (row["kept"], row["excluded_by_category"]) == (2, 5)
    unknown = spark.createDataFrame([(1, " ")], "subject_id long, category string")
    assert P.outcome_counts(P.judge(comps, unknown)).first()["kept"] == 7
    row = P.estimate(P.judge(comps.filter("category = 'kitchenware'"), subjects), subjects).first()
    assert row["reason"].startswith(
        "No relevant comparable products remained after excluding 4 from other categories (not footwear).")


def test_spread(spark):
    rows = [(1, i, p, 0.9, "kept") for i, p in enumerate([30.0, 10.0, 20.0])]
    judged = spark.createDataFrame(
        rows, "subject_id long, product_id long, price double, similarity double, outcome string")
    subjects = spark.createDataFrame([(1, "x"), (2, "x")], "subject_id long, category string")
    est = P.estimate(judged, subjects, strategy="median")
    row = P.price_spread(est).collect()
    assert len(row) == 1 and row[0]["median_price"] == 20 and row[0]["estimate_position"] == 0.5
    assert [r["price"] for r in P.cheapest_first(est).orderBy("position").collect()] == [10, 20, 30]


def test_config_checks():
    with pytest.raises(ValueError):
        PricingConfig(strategy="mode")
    with pytest.raises(ValueError):
        replace(DEFAULTS.recommend, similarity_weight=0.9)
