"""Search jobs: whole query tables against whole catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, Config
from vitrine.operators.fusion import fuse, ranked, single_modality
from vitrine.operators.neighbors import QUERY_FACETS, knn_join
from vitrine.operators.rerank import PairScorer, rerank, token_overlap_logit


def _side(queries: DataFrame, vector: str) -> DataFrame:
    facets = [c for c in QUERY_FACETS if c in queries.columns]
    return queries.filter(F.col(vector).isNotNull()).select(
        "query_id", F.col(vector).alias("vector"), *facets)


def search(queries: DataFrame, image_vectors: DataFrame, text_vectors: DataFrame, k: int,
           cfg: Config = DEFAULTS, neighbors: Callable[..., DataFrame] = knn_join) -> DataFrame:
    """Ranked hits for queries with ``image_vector`` and/or ``text_vector`` (either may be null).

    A query with both sides fuses each side's top ``k``; a query with one side keeps that side's
    raw score. Filter columns on ``queries`` apply before the top-k of each side. ``neighbors`` is the
    join to use: the exact one, or ``functools.partial(knn_lsh, tables=..., bits=...)`` for a very large catalog.
    """
    image_hits = neighbors(_side(queries, "image_vector"), image_vectors, k)
    text_hits = neighbors(_side(queries, "text_vector"), text_vectors, k)
    modes = queries.select(
        "query_id", F.col("image_vector").isNotNull().alias("_image"),
        F.col("text_vector").isNotNull().alias("_text"))
    fused = fuse(image_hits, text_hits, cfg.search).join(modes, "query_id")
    score = (F.when(F.col("_image") & F.col("_text"), F.col("score"))
             .when(F.col("_image"), F.col("image_score")).otherwise(F.col("text_score")))
    return ranked(fused.withColumn("score", score).drop("_image", "_text"), k)


def search_reranked(queries: DataFrame, image_vectors: DataFrame, text_vectors: DataFrame,
                    product_text: DataFrame, k: int, *, scorer: PairScorer = token_overlap_logit,
                    cfg: Config = DEFAULTS) -> DataFrame:
    """``search`` over a deeper pool, reordered by a pair score where the query has text."""
    pool = search(queries, image_vectors, text_vectors, max(k, cfg.rerank.pool), cfg)
    texts = queries.filter(F.col("text_vector").isNotNull()).select("query_id", "query_text")
    reordered = rerank(pool, texts, product_text, k=k, scorer=scorer, cfg=cfg.rerank).select(
        "query_id", "product_id", F.col("rerank_score").alias("score"), "image_score", "text_score",
        "matched_modalities", F.col("final_rank").alias("rank"))
    image_only = pool.join(texts, "query_id", "left_anti").filter(F.col("rank") <= k)
    return reordered.unionByName(image_only.select(reordered.columns))


def self_neighbors(vectors: DataFrame, k: int, within: str | None = None,
                   neighbors: Callable[..., DataFrame] = knn_join) -> DataFrame:
    """The ``k + 1`` nearest of every product among all products, itself included.

    One such table per modality serves every by-product job: a smaller ``k`` is a rank filter.
    """
    columns = ["query_id", "vector"] + ([within] if within else [])
    queries = vectors.withColumn("query_id", F.col("product_id")).select(*columns)
    return neighbors(queries, vectors, k + 1, within=within)


def similar_products(image_hits: DataFrame | None, text_hits: DataFrame | None, k: int,
                     cfg: Config = DEFAULTS) -> DataFrame:
    """Ranked neighbors of every product from its self-neighbor tables, without itself.

    With both tables a product must have both vectors; its two lists are fused.
    """
    depth = F.col("rank") <= k + 1
    if image_hits is not None and text_hits is not None:
        fused = fuse(image_hits.filter(depth), text_hits.filter(depth), cfg.search)
        per_query = Window.partitionBy("query_id")
        merged = fused.withColumns({
            f"_{side}": F.max(F.array_contains("matched_modalities", side)).over(per_query)
            for side in ("image", "text")}).filter("_image AND _text").drop("_image", "_text")
    elif image_hits is not None:
        merged = single_modality(image_hits.filter(depth), "image")
    else:
        merged = single_modality(text_hits.filter(depth), "text")
    return ranked(merged.filter(F.col("query_id") != F.col("product_id")), k)


def missing_vectors(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """Asked products that are not indexed in a required collection."""
    return products.select("product_id").join(vectors.select("product_id"), "product_id", "left_anti")
