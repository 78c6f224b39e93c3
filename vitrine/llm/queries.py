"""The registered queries of the operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    bytepair, hyperminhash, itq, langid, licenses, mincut, packing, quality, stripes, substrings, toxicity, vafile,
    whitening,
)
from vitrine.llm.common import part_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", part_of("doc_id", 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, "doc_id", "held_out")


@query
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    stripped = substrings.remove_repeats(table(spark, sf, "documents"))
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf, "documents"))


@query
def op8_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return itq.linked_vectors(table(spark, sf, "embeddings"))


@query
def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vafile.top_inner_products(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


SQL["op9_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", part_of("doc_id", 5) == 0)
    labels = table(spark, sf, "labels").where(part_of("doc_id", 5) != 0)
    return toxicity.score(docs, toxicity.fit(docs.where(~F.col("held_out")), labels), "doc_id", "held_out")


@query
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bytepair.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bytepair.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, "doc_id").select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))
    return bytepair.decode(encoded, ranks, "doc_id", "n_tokens", "ids_sha256").select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    trusted = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf, "documents"), trusted)


@query
def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


SQL["op1_license_scan"] = licenses.duckdb_sql()


@query
def op11_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return mincut.extract(table(spark, sf, "pages"), "page_id", "url")


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return stripes.collocations(table(spark, sf, "documents"))


SQL["op13_collocations"] = stripes.duckdb_sql()
