from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, VerifyConfig
from vitrine.operators import duplicates as D
from vitrine.operators import explain as X
from vitrine.operators import filters as L
from vitrine.operators import recommend as R
from vitrine.operators.pairs import compare_fields
from vitrine.operators.rerank import model_scorer, rerank, substitute_score
from vitrine.plans import catalog_jobs as J
from vitrine.sources.catalog import PAYLOAD, coerce_payload


def products(spark, *rows):
    """Payload rows with string ids from keyword dictionaries."""
    schema = PAYLOAD
    return coerce_payload(spark.createDataFrame(
        [tuple(r.get(f.name) for f in schema.fields) for r in rows], schema))


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, product_id string, score double, "
                                 "image_score double, text_score double, rank int")


SHOE = dict(name="Runner", brand="Nike", category="footwear", color="Red", material="Mesh", gender="Men",
            season="Summer", style="Running", tags=["Red", " mesh ", "light", "wide"], quality_score=0.9)


def test_identical_metadata_scores_high(spark):
    p = products(spark, dict(SHOE, product_id="a"), dict(SHOE, product_id="b", brand=" nike "))
    row = R.score_candidates(hits(spark, [("a", "b", 1.0, 1.0, 1.0, 1)]), p).first()
    assert row["final_score"] > 0.95
    assert row["matched_attributes"] == ["color", "material", "gender", "season", "style"]
    assert row["shared_brand"] and row["shared_category"]
    assert row["shared_tags"] == ["light", "mesh", "red", "wide"]


def test_missing_values_are_not_penalized(spark):
    p = products(spark, dict(product_id="a", name="x", color="Red"),
                 dict(product_id="b", name="y", color="red", material="Mesh", quality_score=None))
    row = R.score_candidates(hits(spark, [("a", "b", 1.2, 0.0, 0.0, 1)]), p).first()
    assert row["similarity_score"] == 1.0 and row["attribute_score"] == 1.0
    assert row["tag_score"] == 0.0 and row["quality_score"] == 0.0
    assert not row["shared_brand"]


def test_brand_round_robin(spark):
    rows = [("t", f"n{i}", "Nike", 0.9 - i / 100) for i in range(5)] + [
        ("t", "a", "Adidas", 0.5), ("t", "p", "Puma", 0.4), ("t", "s", "Asics", 0.3), ("t", "u", " ", 0.2)]
    scored = spark.createDataFrame(rows, "query_id string, product_id string, brand string, final_score double")
    best = R.brand_round_robin(scored, 4).orderBy("rank").collect()
    assert [r["product_id"] for r in best] == ["n0", "a", "p", "s"]
    assert [r["product_id"] for r in R.brand_round_robin(scored, 7).orderBy("rank").collect()][4:] == [
        "u", "n1", "n2"]
    assert [r["product_id"] for r in R.best_scored(scored, 2).orderBy("rank").collect()] == ["n0", "n1"]


def test_explanation_sentence(spark):
    base = dict(similarity_score=0.8, shared_category=True, shared_brand=False,
                matched_attributes=["color"], shared_tags=["a", "b", "c", "d"], quality_score=0.7)
    schema = ("similarity_score double, shared_category boolean, shared_brand boolean, "
              "matched_attributes array<string>, shared_tags array<string>, quality_score double")
    plain = dict(base, similarity_score=0.1, shared_category=False, matched_attributes=[], shared_tags=[],
                 quality_score=0.0)
    frame = spark.createDataFrame([tuple(r.values()) for r in (base, plain)], schema)
    got = [r[0] for r in frame.select(R.explanation_text()).collect()]
    assert got[0] == ("Similar visual appearance; same category; shared attributes (color); "
                      "matching tags (a, b, c); high catalog quality.")
    assert got[1] == "Related based on overall similarity."


def test_duplicate_signals_and_threshold(spark):
    p = products(spark, dict(product_id="a", name="Runner", brand="Nike"),
                 dict(product_id="b", name="Runner", brand="Nikee"))
    scored = D.score_pairs(hits(spark, [("a", "b", 0.9, 1.3, -0.1, 1)]), p, p).first()
    assert 0.7 < scored["metadata_signal"] < 1.0
    assert scored["image_signal"] == 1.0 and scored["text_signal"] == 0.0
    ids = spark.createDataFrame([("a",), ("z",)], "query_id string")
    rows = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.4)],
                                 "query_id string, product_id string, overall_similarity double")
    got = {r["query_id"]: r for r in D.decide(ids, rows).collect()}
    assert got["a"]["is_duplicate"] and got["a"]["matched_product"] == "b"
    assert got["a"]["reason"] == "Overall similarity 0.90 meets or exceeds the 0.90 threshold."
    assert [c["product_id"] for c in got["a"]["top_candidates"]] == ["b", "c"]
    assert got["z"]["reason"] == "No candidates were found to compare against."
    shaped = D.as_verification(D.decide(ids, rows)).filter("query_id = 'a'").first()
    assert shaped["cross_encoder_score"] is None and shaped["reasons"][0]["code"] == "weighted_similarity"


def test_gate_modes(spark):
    p = products(spark, dict(product_id="a", name="x"), dict(product_id="b", name="y"))
    decisions = spark.createDataFrame([("a", True, "b", 0.95)],
                                      "query_id string, is_duplicate boolean, matched_product string, confidence double")
    assert D.gate(p, decisions, "block").select("product_id").collect()[0][0] == "b"
    assert D.gate(p, decisions, "warn").filter("is_duplicate").count() == 1
    assert D.gate(p, decisions, "off").filter("is_duplicate").count() == 0
    with pytest.raises(ValueError):
        D.gate(p, decisions, "maybe")


def ruled(spark, a, b, cfg=DEFAULTS.verify):
    p = products(spark, dict(a, product_id="a"), dict(b, product_id="b"))
    pair = spark.createDataFrame([("a", "b")], "query_id string, product_id string")
    return D.apply_rules(pair, p, p, cfg).first()


def test_business_rules(spark):
    row = ruled(spark, dict(brand="Nike"), dict(brand="nike"))
    assert row["rule_score"] == 1.0 and not row["veto"] and [r["code"] for r in row["rules"]] == ["same_brand"]
    row = ruled(spark, dict(brand="Nike"), dict(brand="Adidas"), VerifyConfig(require_same_brand=True))
    assert row["veto"] and row["rules"][0]["message"] == "Different brand (Nike vs Adidas)"
    row = ruled(spark, dict(SHOE, price=100.0), dict(SHOE, price=90.0, category="Foot wear", name="Hat"))
    assert {r["code"] for r in row["rules"]} == {
        "same_brand", "same_category", "close_price", "title_difference", "attribute_overlap"}
    assert ruled(spark, {}, {})["rule_score"] == 0.0


def test_rerank_and_verify(spark):
    p = products(spark, dict(SHOE, product_id="t"), dict(SHOE, product_id="same"),
                 dict(product_id="far", name="Lamp", brand="Lumen", category="lighting"))
    h = hits(spark, [("t", "far", 0.9, 0.9, 0.9, 1), ("t", "same", 0.8, 0.8, 0.8, 2)])
    out = rerank(h, J.query_texts(p), J.product_texts(p)).orderBy("final_rank").collect()
    assert [r["product_id"] for r in out] == ["same", "far"]
    assert out[0]["rank_delta"] == 1
    assert out[0]["explanation"] == "Moved up from position 2 to 1 after cross-encoder reranking."
    assert out[1]["explanation"] == "Moved down from position 1 to 2 after cross-encoder reranking."
    targets = p.filter("product_id = 't'")
    verdict = J.verify_duplicates(h, targets, p).first()
    assert verdict["is_duplicate"] and verdict["matched_product"] == "same"
    nothing = J.verify_duplicates(h.filter("false"), targets, p).first()
    assert nothing["reasons"][0]["code"] == "no_candidates" and nothing["confidence"] == 0.0
    small = replace(DEFAULTS, rerank=replace(DEFAULTS.rerank, pool=1))
    assert rerank(h, J.query_texts(p), J.product_texts(p), cfg=small.rerank).count() == 1
    changed = substitute_score(h, rerank(h, J.query_texts(p), J.product_texts(p), k=1), "text_score")
    assert changed.count() == 1 and changed.first()["text_score"] == pytest.approx(0.982, abs=1e-3)


def test_model_scorer(spark):
    def load():
        def predict(a, b):
            return np.array([float(len(x) - abs(len(x) - len(y))) for x, y in zip(a, b)])

        return predict

    frame = spark.createDataFrame([("abc", "abcd"), ("a", "a")], "a string, b string")
    got = [r[0] for r in frame.select(model_scorer(load, 2)(F.col("a"), F.col("b"))).collect()]
    assert got == [2.0, 1.0]


def test_compare_fields(spark):
    p = products(spark, dict(product_id="a", brand="Nike ", color="Red"), dict(product_id="b", brand="nike", color="Blue"))
    pair = spark.createDataFrame([("a", "b")], "query_id string, product_id string")
    got = {r["field"]: r["verdict"] for r in compare_fields(pair, p, p, ["brand", "color", "style"]).collect()}
    assert got == {"brand": "same", "color": "different", "style": "incomparable"}


def test_jobs_end_to_end(spark):
    """Twins outrank the rest, are flagged, priced from their category, and explained."""
    p = products(spark, dict(SHOE, product_id="s1", price=129.99), dict(SHOE, product_id="s2", price=134.99),
                 dict(product_id="m1", name="Mug", brand="Kiln", category="kitchenware", price=24.5),
                 dict(product_id="l1", name="Lamp", brand="Lumen", category="lighting", price=45.0))
    v = {"s1": [1.0, 0.0, 0.1], "s2": [0.99, 0.02, 0.1], "m1": [0.0, 1.0, 0.0], "l1": [0.1, 0.3, 1.0]}
    vectors = spark.createDataFrame(list(v.items()), "product_id string, vector array<double>")
    from vitrine.plans.search import self_neighbors, similar_products

    near = self_neighbors(vectors, 30)
    recs = J.recommend(near, near, p, k=3)
    assert recs.filter("query_id = 's1' and rank = 1").first()["product_id"] == "s2"
    reranked = J.recommend(near, near, p, k=3, reranked=True)
    assert reranked.filter("query_id = 's1' and rank = 1").first()["product_id"] == "s2"
    similar = similar_products(near, near, 10)
    decisions = J.detect_duplicates(similar, p, p)
    flagged = {r["query_id"]: r["matched_product"] for r in decisions.filter("is_duplicate").collect()}
    assert flagged == {"s1": "s2", "s2": "s1"}
    subjects = p.select(F.col("product_id").alias("subject_id"), "category")
    price = {r["subject_id"]: r for r in J.price(similar, subjects, p).collect()}
    assert price["s1"]["estimated_price"] == 134.99 and price["s1"]["confidence"] == "low"
    assert price["l1"]["estimated_price"] is None
    traces = J.explain_products(decisions, recs)
    mine = traces.filter("query_id = 's1'").collect()
    assert mine[0]["decision_type"] in ("duplicate", "recommendation")
    assert {t["decision_type"] for t in mine} == {"duplicate", "recommendation"}
    strict = J.strict_verification()
    assert J.verify_duplicates(similar, p, p, cfg=strict).filter("is_duplicate").count() == 2


def test_trace_weights_add_up(spark):
    p = products(spark, dict(SHOE, product_id="a"), dict(SHOE, product_id="b"))
    recs = R.score_candidates(hits(spark, [("a", "b", 0.6, 0.6, 0.6, 1)]), p)
    t = X.explain_recommendation(recs).first()
    assert sum(c["contribution"] for c in t["components"]) == pytest.approx(t["total"])
    assert t["summary"] == ("Recommended because it shares: the same brand, the same category, matching color, "
                            "material, gender, season, style, and shared tags (light, mesh, red, wide).")


def test_ingest_blocks_and_rejects(spark):
    raw = spark.createDataFrame(
        [("a", " Red shirt ", "Nike", "Men Shirts", "soft cotton", 10.555, 2), ("b", "Copy", None, None, None, 5.0, 2),
         ("c", "  ", None, None, None, 1.0, 2), ("d", "x", None, None, None, -1.0, 2)],
        "product_id string, name string, brand string, category string, description string, price double, version int")
    decisions = spark.createDataFrame([("b", True, "a", 0.95)],
                                      "query_id string, is_duplicate boolean, matched_product string, confidence double")
    empty = spark.createDataFrame([], ("product_id string, name string, brand string, category string, description string, "
                                       "price double, brand_key string, category_key string, color string, material string, "
                                       "gender string, season string, style string, tags array<string>, quality_score double, version int"))
    table, rejected = J.ingest(raw, empty, decisions, mode="block")
    rows = table.collect()
    assert [r["product_id"] for r in rows] == ["a"]
    assert rows[0]["category"] == "men-shirts" and rows[0]["price"] == 10.56 and rows[0]["color"] == "Red"
    assert rows[0]["name"] == "Red shirt" and "cotton" in rows[0]["tags"]
    assert {r["product_id"]: r["reject_reason"] for r in rejected.collect()} == {
        "c": "name is blank", "d": "price is negative"}


def test_input_checks(spark):
    files = spark.createDataFrame([(".JPG", "image/jpeg", 10), (".gif", "image/gif", 10), (".png", "text/html", 1),
                                   (".webp", "image/webp", 10 * 1024 * 1024 + 1)],
                                  "extension string, mime_type string, size_bytes long")
    assert [r["reject_reason"] for r in L.check_files(files).collect()] == [
        None, "extension", "mime type", "too large"]
    q = spark.createDataFrame([(1, [1.0], " "), (2, None, "x"), (3, None, " "), (4, [1.0], "x")],
                              "query_id long, image_vector array<double>, text string")
    assert [r["mode"] for r in L.check_query_presence(q).collect()] == ["image", "text", None, "hybrid"]
    s = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "query_id string, position int")
    assert [r[0] for r in L.subset(s, ids=["a", "c"], limit=1).collect()] == ["c"]
