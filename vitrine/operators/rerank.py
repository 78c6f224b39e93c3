"""Second-stage scoring of the head of a hit list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vitrine.config import DEFAULTS, RerankConfig
from vitrine.functions.scalars import rank_value, sigmoid

#: From a query's and a product's text to a logit. An attribute ``prepare`` is applied to each text before the join.
PairScorer = Callable[[Column, Column], Column]


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def token_overlap_logit(query: Column, document: Column) -> Column:
    """Default pair score: Jaccard overlap of two arrays of ``distinct_words``, stretched to [-4, 4]."""
    shared = F.size(F.array_intersect(query, document)).cast("double")
    every = F.size(query) + F.size(document) - shared
    return 8.0 * F.coalesce(F.try_divide(shared, every.cast("double")), F.lit(0.0)) - 4.0


token_overlap_logit.prepare = distinct_words


def model_scorer(make_predict: Callable, batch_size: int = DEFAULTS.rerank.batch_size) -> PairScorer:
    """A pair scorer backed by a model; ``make_predict`` loads it once per worker.

    The loaded function takes two arrays of strings and returns one array of logits.
    """
    return predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)


def movement(original: Column, final: Column) -> Column:
    tail = F.lit(" after cross-encoder reranking.")
    o, f = original.cast("string"), final.cast("string")
    return (
        F.when(final < original, F.concat(F.lit("Moved up from position "), o, F.lit(" to "), f, tail))
        .when(final > original, F.concat(F.lit("Moved down from position "), o, F.lit(" to "), f, tail))
        .otherwise(F.concat(F.lit("Kept at position "), f, tail))
    )


def rerank(hits: DataFrame, query_text: DataFrame, product_text: DataFrame, *,
           k: int | None = None, scorer: PairScorer = token_overlap_logit,
           cfg: RerankConfig = DEFAULTS.rerank) -> DataFrame:
    """Reorder the first ``cfg.pool`` hits of each query by a pair score.

    ``hits`` carries ``rank``; the texts are (query_id, query_text) and (product_id, text). The
    pool is cut before the scorer runs. Adds rerank_score, original_rank, final_rank, rank_delta
    and explanation; ``score`` keeps the retrieval score.
    """
    pool = hits.filter(F.col("rank") <= cfg.pool)
    prepare = getattr(scorer, "prepare", lambda text: text)
    scored = (
        pool.join(product_text.select("product_id", prepare(F.col("text")).alias("_doc")), "product_id")
        .join(query_text.select("query_id", prepare(F.col("query_text")).alias("_ask")), "query_id")
        .withColumn("_logit", scorer(F.col("_ask"), F.col("_doc")))
        .withColumnRenamed("rank", "original_rank")
        .withColumn("_by", rank_value(F.col("_logit")))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("_by").desc(), F.col("original_rank"))
    out = scored.withColumn("final_rank", F.row_number().over(order))
    if k is not None:
        out = out.filter(F.col("final_rank") <= k)
    return out.withColumns({
        "rerank_score": sigmoid(F.col("_logit")),
        "rank_delta": F.col("original_rank") - F.col("final_rank"),
        "explanation": movement(F.col("original_rank"), F.col("final_rank")),
    }).drop("_doc", "_ask", "_logit", "_by")


def substitute_score(hits: DataFrame, reranked: DataFrame, column: str = "score") -> DataFrame:
    """Replace a score by the rerank score; hits that were not reranked drop out."""
    new = reranked.select("query_id", "product_id", F.col("rerank_score").alias("_new"))
    return hits.join(new, ["query_id", "product_id"]).withColumn(column, F.col("_new")).drop("_new")
