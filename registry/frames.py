"""How the supplied tables play the roles of a catalog, its vectors and its logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.scalars import facet_key, l2_normalize
from vitrine.session import prepare

# Product descriptions by p_size: the supplied texts hold no catalog vocabulary.
PHRASES = (
    "Trail runner in red, airy mesh, very lightweight",
    "Striped wool shawl for winter, blue with some red",
    "Women's summer dress in floral silk, navy",
    "slightly reddish, no pattern at all",
    "Levi's denim jeans for men, classic and durable",
    "Kids waterproof jacket, eco-friendly nylon, all-season",
    "Unisex grey hoodie, premium cotton, casual, washable",
    "New Balance sneakers, black suede, gym workout",
    "Office shirt, white linen, formal, quick-dry",
    "Toddler boots, brown leather, anti-slip rubber sole",
    "Polka dot party dress, pink velvet",
    "Plain steel part",
)
EVENT_NAMES = {"signup": "upload", "click": "duplicate_check", "purchase": "recommendation",
               "view": "search", "error": "error"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """All parts as stored products."""
    part = table(spark, sf, "part")
    words = F.split("p_name", " ")
    size = F.col("p_size")
    season = F.element_at(F.array(*map(F.lit, ("Summer", "Winter", "Spring", "Fall"))), size % 4 + 1)
    style = F.when(size % 3 == 1, "Casual").when(size % 3 == 2, "Formal")
    return part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.lit(None).cast("string").alias("description"), F.col("p_retailprice").alias("price"),
        words[0].alias("color"), words[1].alias("material"),
        F.lit(None).cast("string").alias("gender"), season.alias("season"), style.alias("style"),
        F.array(words[0], words[1], F.lower("p_type")).alias("tags"),
        (size / F.lit(50.0)).alias("quality_score"),
        facet_key(F.col("p_brand")).alias("brand_key"),
        facet_key(F.col("p_type")).alias("category_key"))


def submitted(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as newly submitted products: a phrase and the document of the same id as description."""
    part = table(spark, sf, "part")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), F.col("p_size") % len(PHRASES) + 1)
    brand = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    category = F.when(F.col("p_size") % 7 != 0, F.col("p_type"))
    # Documents are the large side of this join; broadcasting them would also leave one task per part file.
    return part.join(docs.hint("merge"), "p_partkey", "left").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), brand.alias("brand"),
        category.alias("category"), F.concat_ws(" ", phrase, "text").alias("description"),
        F.col("p_retailprice").alias("price"))


def _vectors(spark: SparkSession, sf: str, vector) -> DataFrame:
    """Vectors of the parts that have one, with the facets filters refer to."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("product_id"), vector.alias("vector"))
    facets = catalog(spark, sf).select("product_id", "brand_key", "category_key", "price")
    return vectors.join(facets, "product_id")


def image_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf, F.slice("embedding", 1, 32))


def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf, F.slice("embedding", 33, 32))


def full_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf, F.col("embedding"))


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Products that have vectors."""
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"))
    return catalog(spark, sf).join(ids, "product_id", "left_semi")


def unit(column: str):
    return l2_normalize(F.col(column))


def filtered_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every product as a query with its own mix of filters."""
    size = F.col("p_size")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), "p_size")
    price = F.col("price")
    return full_vectors(spark, sf).join(part, "product_id").select(
        F.col("product_id").alias("query_id"), "vector",
        F.when(size % 2 == 0, F.col("brand_key")).alias("brand_key"),
        F.when(size % 3 == 0, F.when(size % 9 == 0, F.lit("no-such-category")).otherwise(
            F.col("category_key"))).alias("category_key"),
        F.when(size % 5 == 0, price - 20).alias("min_price"),
        F.when(size % 5 < 2, price + 20).alias("max_price"))


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    events = table(spark, sf, "events")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("tenant_id"),
        F.element_at(names, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "signup", F.col("value")).alias("seconds"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as the attempts of one job; an error event is a failed attempt."""
    events = table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("attempt"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), F.col("props")))
        .alias("error"),
        F.col("ts").alias("completed_at"))


PIXEL_SIDE = 8


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as an 8 x 8 image: one entry per pixel, channels from shifted entries."""
    def channel(shift: int):
        v = F.element_at("embedding", F.pmod(F.col("i") + shift, F.lit(64)) + 1).cast("double")
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v + 0.3) * 425.0)) / 32).cast(
            "int") * 32

    base = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return base.select(
        "image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"),
        channel(0).alias("r"), channel(21).alias("g"), channel(42).alias("b"))


def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"), (F.col("p_size") * 40).alias("width"),
        (F.col("p_size") % 7 * 200 + 100).alias("height"))
