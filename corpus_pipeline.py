"""Cleans a table of documents and packs it: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm import hyperminhash, langid, packing, substrings, toxicity
from vitrine.llm.common import stored, table
from vitrine.session import prepare

#: Posterior probability of its language below which a document is rejected.
SURE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one value beside its text, so that no name of its columns can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Learns from all documents with a language; where none has one,
    nothing can be recognised and all documents with a letter stay."""
    prepare(spark)
    model = langid.fit(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(_rows(docs), model, "row")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not find toxic."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_rows(docs), net, "row").where("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, and rows without a doc_id.

    Of several rows with that doc_id the one with the smallest text stays.
    """
    prepare(spark)
    ids = hyperminhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))
    whole = docs.join(ids, "doc_id", "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = whole.withColumn("place", place).where("place = 1").select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that an earlier one has; those of nothing else go."""
    prepare(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    left = substrings.remove_repeats(docs, carry=others, layout=True)
    left = left.where("n_removed = 0 or n_removed < n_words").withColumnRenamed("kept_text", "text")
    if "n_chars" in others:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(
            F.col("n_chars")))
    return left.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", pack)]
#: The models cannot be expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
