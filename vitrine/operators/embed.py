"""Embedding interfaces: a model loaded once per worker, or a built-in default."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_BATCH, IMAGE_BATCH = 32, 8


def model_embedder(make_predict: Callable, batch_size: int = TEXT_BATCH,
                   input_shape: list[int] | None = None) -> Callable[[Column], Column]:
    """``make_predict`` loads a model and returns a function from a batch to a matrix.

    The vectors come out with unit length. ``input_shape`` is the shape of one input that is an array, such as the
    pixels of an image.
    """
    def make_unit():
        predict = make_predict()

        def run(batch):
            m = np.asarray(predict(batch), dtype=np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return (m / np.where(norm == 0, 1.0, norm)).astype(np.float32)

        return run

    return predict_batch_udf(make_unit, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                             input_tensor_shapes=[input_shape] if input_shape else None)


def _word_counts(products: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, n): hashed lower-case words; a bucket is the first 32 bits of the word's MD5 modulo ``dim``."""
    words = F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("w")
    bucket = (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
    return products.select(key, words).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fit_text_weights(products: DataFrame, key: str = "product_id", text: str = "text", dim: int = 384) -> DataFrame:
    """(bucket, idf) of a catalog, one row for each of ``dim`` buckets. Fit once; use for products and queries."""
    total = products.agg(F.count("*").cast("double")).scalar()
    seen = _word_counts(products, key, text, dim).groupBy("bucket").agg(F.count("*").alias("df"))
    every = products.sparkSession.range(dim).select(F.col("id").cast("int").alias("bucket"))
    df = F.coalesce("df", F.lit(0)).cast("double")
    return every.join(seen, "bucket", "left").select("bucket", F.log((total + 1) / (df + 1)).alias("idf"))


def hashed_text_vectors(products: DataFrame, weights: DataFrame, key: str = "product_id", text: str = "text",
                        dim: int = 384) -> DataFrame:
    """Default text vectors: (key, vector) of hashed word counts, weighted by ``fit_text_weights``, of unit length."""
    counted = _word_counts(products, key, text, dim).join(F.broadcast(weights), "bucket")  # dim rows
    entries = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.struct("bucket", (F.col("n") * F.col("idf")).alias("value")))).alias("m"))
    norm = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x * x))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (
        F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("norm")), F.lit(0.0))).cast("float"))
    return products.select(key).join(entries.withColumn("norm", norm), key, "left").select(
        key, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(dense).alias("vector"))
