"""A duplicate gate over a stream of submitted products.

Each micro-batch is held against the catalog and against what earlier batches let through, then against itself: of
products of one batch that are duplicates of each other the first one in order wins, and one that was turned away turns
nobody away. The products let through are the signatures that later batches meet. Every batch reads the folders of
smaller batch ids only and overwrites those of its own, so a batch that is run again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.config import DEFAULTS, DuplicateConfig
from vitrine.functions.scalars import rank_value
from vitrine.operators.blocked import duplicate_pairs
from vitrine.session import materialize

MODES = ("off", "warn", "block")
VERDICT = "product_id {0}, is_duplicate boolean, matched_product {0}, confidence double, accepted boolean"


def first_wins(rows: DataFrame, links: DataFrame, settled: DataFrame) -> DataFrame:
    """(product_id, accepted): goes through ``rows`` by ``place`` and turns away each that an accepted one is linked to.

    ``links`` is (earlier, later) among the rows, ``settled`` the ids that are turned away from the start. A round
    decides every row without an undecided earlier partner, so there are as many rounds as the longest chain of links.
    """
    open_ = rows.select("product_id").join(settled, "product_id", "left_anti")
    done = materialize(settled.select("product_id", F.lit(False).alias("accepted")), "decided")
    links = materialize(links.select("earlier", "later"), "links")
    while True:
        waiting = materialize(open_, "waiting")
        if waiting.isEmpty():
            return done
        early = waiting.select(F.col("product_id").alias("earlier"))
        held = links.join(early, "earlier", "left_semi").select(F.col("later").alias("product_id")).distinct()
        taken = materialize(waiting.join(held, "product_id", "left_anti"), "taken")
        refused = materialize(links.join(taken.select(F.col("product_id").alias("earlier")), "earlier", "left_semi").select(
            F.col("later").alias("product_id")).distinct().join(waiting, "product_id", "left_semi"), "refused")
        done = materialize(done.unionByName(taken.withColumn("accepted", F.lit(True))).unionByName(
            refused.withColumn("accepted", F.lit(False))), "decided")
        open_ = waiting.join(done, "product_id", "left_anti")


def judge_batch(batch: DataFrame, known: DataFrame, mode: str = "block",
                cfg: DuplicateConfig = DEFAULTS.duplicate) -> DataFrame:
    """(product_id, is_duplicate, matched_product, confidence, accepted) for the products of one batch.

    ``batch`` and ``known`` have the product columns, ``image_vector``, ``text_vector``, and the batch ``place``, its
    order. A product is no duplicate of the stored version of itself. ``off`` accepts all unseen, ``warn`` marks
    duplicates of anything known or earlier in the batch and accepts them, ``block`` turns them away.
    """
    if mode not in MODES:
        raise ValueError(f"unknown duplicate mode {mode!r}")
    order = Window.partitionBy("product_id").orderBy(F.col("place").desc())
    batch = materialize(batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"), "batch")
    if mode == "off":
        return batch.select("product_id", F.lit(False).alias("is_duplicate"), F.lit(None).cast(
            batch.schema["product_id"].dataType).alias("matched_product"), F.lit(0.0).alias("confidence"),
            F.lit(True).alias("accepted"))
    ids = batch.select("product_id")
    columns = [c for c in batch.columns if c != "place"]
    everything = known.select(*columns).join(ids, "product_id", "left_anti").unionByName(batch.select(*columns))

    def vectors(name: str) -> DataFrame:
        return everything.where(F.col(name).isNotNull()).select("product_id", F.col(name).alias("vector"))

    pairs = materialize(duplicate_pairs(
        vectors("image_vector"), vectors("text_vector"), everything.drop("image_vector", "text_vector"), cfg,
        fresh=ids).select("query_id", "product_id", "overall_similarity"), "pairs")
    both = pairs.selectExpr("query_id as other", "product_id", "overall_similarity").unionByName(
        pairs.selectExpr("product_id as other", "query_id as product_id", "overall_similarity"))
    places = batch.select("product_id", "place")
    placed = both.join(places, "product_id").join(
        places.selectExpr("product_id as other", "place as other_place"), "other", "left")
    linked = materialize(placed.where("other_place is null or other_place < place"), "links")
    if mode == "block":
        settled = linked.where("other_place is null").select("product_id").distinct()
        accepted = first_wins(batch, linked.where("other_place is not null").selectExpr(
            "other as earlier", "product_id as later"), settled)
        by = linked.join(accepted.where("accepted").select(F.col("product_id").alias("other"), F.lit(True).alias("_in")),
                         "other", "left").where("other_place is null or _in")
    else:
        accepted, by = ids.withColumn("accepted", F.lit(True)), linked
    best = by.groupBy("product_id").agg(F.min_by(F.struct("other", "overall_similarity"), F.struct(
        -rank_value(F.col("overall_similarity")), "other")).alias("best"))
    return accepted.join(best, "product_id", "left").select(
        "product_id", F.col("best").isNotNull().alias("is_duplicate"), F.col("best.other").alias("matched_product"),
        F.coalesce("best.overall_similarity", F.lit(0.0)).alias("confidence"), "accepted")


def run_batch(batch: DataFrame, batch_id: int, catalog: DataFrame, path: str, mode: str, cfg: DuplicateConfig) -> None:
    """Judges one micro-batch and overwrites its folders of decisions and accepted products below ``path``."""
    spark = batch.sparkSession
    known = catalog
    if batch_id:
        schema = StructType([f for f in batch.schema.fields if f.name != "place"]).add("batch_id", "long")
        earlier = spark.read.schema(schema).option("basePath", f"{path}/accepted").parquet(f"{path}/accepted").where(
            F.col("batch_id") < batch_id)
        newest = Window.partitionBy("product_id").orderBy(F.desc("batch_id"))
        earlier = earlier.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch_id")
        known = catalog.join(earlier.select("product_id"), "product_id", "left_anti").select(*earlier.columns).unionByName(earlier)
    verdicts = materialize(judge_batch(batch, known, mode, cfg), "verdicts")
    verdicts.write.mode("overwrite").parquet(f"{path}/decisions/batch_id={batch_id}")
    order = Window.partitionBy("product_id").orderBy(F.col("place").desc())
    newest = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "place")
    newest.join(verdicts.where("accepted").select("product_id"), "product_id", "left_semi").write.mode("overwrite").parquet(
        f"{path}/accepted/batch_id={batch_id}")


def start_gate(stream: DataFrame, catalog: DataFrame, path: str, checkpoint: str, *, mode: str = "block",
               cfg: DuplicateConfig = DEFAULTS.duplicate):
    """Starts the gate over what is available; ``decisions`` reads what it decided."""
    def each(batch: DataFrame, batch_id: int) -> None:
        run_batch(batch, batch_id, catalog, path, mode, cfg)

    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def decisions(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """The verdict of every submission: one row for each product and batch."""
    return spark.read.schema(VERDICT.format(id_type) + ", batch_id long").option("basePath", f"{path}/decisions").parquet(
        f"{path}/decisions")
