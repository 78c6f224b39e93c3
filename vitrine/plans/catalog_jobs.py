"""End-to-end jobs over a catalog: recommend, detect and verify duplicates, price, ingest,
evaluate, explain."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, Config
from vitrine.functions.scalars import payload_text, text_representation
from vitrine.operators import duplicates as D
from vitrine.operators import enrich as E
from vitrine.operators import evaluate as V
from vitrine.operators import explain as X
from vitrine.operators import pricing as P
from vitrine.operators import recommend as R
from vitrine.operators.filters import normalize_products, split_rejected
from vitrine.operators.rerank import PairScorer, rerank, substitute_score, token_overlap_logit
from vitrine.plans.search import search, similar_products
from vitrine.sources.sinks import upsert


def product_texts(products: DataFrame) -> DataFrame:
    """(product_id, text) as second-stage scorers see a stored product."""
    return products.select("product_id", payload_text(
        F.col("product_id"), F.col("name"), F.col("brand"), F.col("category"),
        F.col("description")).alias("text"))


def query_texts(products: DataFrame) -> DataFrame:
    """(query_id, query_text) of described products."""
    return products.select(F.col("product_id").alias("query_id"), text_representation(
        F.col("name"), F.col("brand"), F.col("category"), F.col("description")).alias("query_text"))


def recommendation_depth(k: int, reranked: bool, cfg: Config = DEFAULTS) -> int:
    """How many candidates are fetched so that diversity and reranking have a choice."""
    depth = k * cfg.recommend.overfetch if cfg.recommend.diversity else k
    return max(depth, cfg.rerank.pool) if reranked else depth


def recommend(image_hits: DataFrame | None, text_hits: DataFrame, products: DataFrame, *,
              k: int | None = None, reranked: bool = False,
              scorer: PairScorer = token_overlap_logit, cfg: Config = DEFAULTS) -> DataFrame:
    """A recommendation table for every product.

    ``similar`` recommendations use both self-neighbor tables; pass ``image_hits=None`` for
    ``related`` (and ``complementary``) ones, which use text only. The tables must reach
    ``recommendation_depth``.
    """
    k = k or cfg.recommend.top_k
    depth = recommendation_depth(k, reranked, cfg)
    hits = similar_products(image_hits, text_hits, depth, cfg)
    if reranked:
        second = rerank(hits, product_texts(products).select(
            F.col("product_id").alias("query_id"), F.col("text").alias("query_text")),
            product_texts(products), scorer=scorer, cfg=cfg.rerank)
        hits = substitute_score(hits, second)
    scored = R.score_candidates(hits, products, cfg.recommend)
    best = R.brand_round_robin(scored, k) if cfg.recommend.diversity else R.best_scored(scored, k)
    return best.withColumn("explanation", R.explanation_text(cfg.recommend))


def detect_duplicates(hits: DataFrame, targets: DataFrame, catalog: DataFrame, *,
                      reranked: bool = False, scorer: PairScorer = token_overlap_logit,
                      cfg: Config = DEFAULTS) -> DataFrame:
    """One decision per target from its ranked hits.

    Hits come from ``search`` for new products and from ``similar_products`` for indexed ones.
    """
    if reranked:
        second = rerank(hits, query_texts(targets), product_texts(catalog), scorer=scorer,
                        cfg=cfg.rerank)
        hits = substitute_score(hits, second, "text_score")
    scored = D.score_pairs(hits, targets, catalog, cfg.duplicate)
    return D.decide(targets.select(F.col("product_id").alias("query_id")), scored, cfg.duplicate)


def verify_duplicates(hits: DataFrame, targets: DataFrame, catalog: DataFrame, *,
                      scorer: PairScorer = token_overlap_logit, cfg: Config = DEFAULTS) -> DataFrame:
    """Second-stage verdict per target: rerank its hits, then check the business rules."""
    second = rerank(hits, query_texts(targets), product_texts(catalog), scorer=scorer, cfg=cfg.rerank)
    return D.verify(targets.select(F.col("product_id").alias("query_id")), second, targets, catalog,
                    cfg.verify)


def price(hits: DataFrame, subjects: DataFrame, products: DataFrame, *, strategy: str | None = None,
          cfg: Config = DEFAULTS) -> DataFrame:
    """Estimates from ranked hits; ``subjects`` is (subject_id, category)."""
    judged = P.judge(P.comparables(hits, products), subjects, cfg.pricing)
    return P.estimate(judged, subjects, cfg.pricing, strategy)


def price_described(described: DataFrame, text_vectors: DataFrame, products: DataFrame, embed, *,
                    strategy: str | None = None, cfg: Config = DEFAULTS) -> DataFrame:
    """Prices for products that are only described: text search for comparables, then ``price``.

    ``embed`` turns a (query_id, text) frame into (query_id, vector).
    """
    asked = query_texts(described).withColumnRenamed("query_text", "text")
    queries = embed(asked).select(
        "query_id", F.lit(None).cast(text_vectors.schema["vector"].dataType).alias("image_vector"),
        F.col("vector").alias("text_vector"))
    hits = search(queries, text_vectors.limit(0), text_vectors, cfg.pricing.top_k, cfg)
    subjects = described.select(F.col("product_id").alias("subject_id"), "category")
    return price(hits, subjects, products, strategy=strategy, cfg=cfg)


def ingest(raw: DataFrame, catalog: DataFrame, decisions: DataFrame | None, *, mode: str = "warn",
           image_predictions: DataFrame | None = None, image_tags: DataFrame | None = None,
           cfg: Config = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(catalog after the upsert, rejected rows).

    Raw rows are checked, enriched from the submitted values, gated on their duplicate decision,
    normalized and upserted by id.
    """
    accepted, rejected = split_rejected(raw)
    enriched = E.enrich(accepted, image_predictions, image_tags, cfg.enrich)
    stored = E.payload(normalize_products(accepted), enriched).join(
        accepted.select("product_id", "version"), "product_id")
    if decisions is not None and mode != "off":
        gated = D.gate(stored, decisions, mode)
        stored = gated.drop("is_duplicate", "matched_product", "confidence")
    return upsert(catalog, stored), rejected


def evaluate(queries: DataFrame, ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Task summary of already retrieved results.

    ``queries`` is (query_id, task_type, error, latency_seconds); a failed query keeps its error
    and stays out of the means.
    """
    counts = V.expected_counts(expected)
    asked = queries.join(counts, "query_id", "left").na.fill(0, ["n_expected"])
    return V.task_metrics(V.query_metrics(asked, V.flag_relevance(ranked, expected)))


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two task summaries, e.g. without and with reranking."""
    return V.report_difference(V.long_form(before), V.long_form(after))


def explain_products(decisions: DataFrame, recommendations: DataFrame,
                     cfg: Config = DEFAULTS) -> DataFrame:
    """All traces per product: the duplicate verdict and every recommendation."""
    return X.combined(X.explain_duplicate(D.as_verification(decisions)),
                      X.explain_recommendation(recommendations, cfg.recommend))


def strict_verification(cfg: Config = DEFAULTS) -> Config:
    """The configuration that vetoes a differing brand or category."""
    return replace(cfg, verify=replace(cfg.verify, require_same_brand=True,
                                       require_same_category=True))


def cached_recommendations(recs: DataFrame, computed_at: Column) -> DataFrame:
    """Recommendations as rows of the cache table."""
    return recs.withColumnRenamed("query_id", "for_product_id").withColumn("computed_at", computed_at)
