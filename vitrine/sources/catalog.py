"""Catalog, vector and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.scalars import blank_to_null, facet_key

RAW_PRODUCT = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("name", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("price", T.DoubleType()),
])
PAYLOAD = T.StructType(RAW_PRODUCT.fields + [
    T.StructField("color", T.StringType()), T.StructField("material", T.StringType()),
    T.StructField("gender", T.StringType()), T.StructField("season", T.StringType()),
    T.StructField("style", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("quality_score", T.DoubleType()), T.StructField("image_filename", T.StringType()),
    T.StructField("brand_key", T.StringType()), T.StructField("category_key", T.StringType()),
])


def coerce_payload(df: DataFrame) -> DataFrame:
    """Payload rows of any age: blanks become null, missing columns appear, tags are never null."""
    columns = []
    for f in PAYLOAD.fields:
        if f.name not in df.columns:
            value = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType) and f.name != "product_id":
            value = blank_to_null(F.col(f.name).cast("string"))
        elif isinstance(f.dataType, T.DoubleType):
            value = F.col(f.name).try_cast("double")
        else:
            value = F.col(f.name)
        columns.append(value.alias(f.name))
    out = df.select(*columns)
    return out.withColumns({
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "brand_key": F.coalesce("brand_key", facet_key(F.col("brand"))),
        "category_key": F.coalesce("category_key", facet_key(F.col("category"))),
    })


def read_products(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored products; numbers of other formats than Parquet are read as text, so that "12.5" is a price, too."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(T.StructType([
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DoubleType) else f.dataType)
            for f in PAYLOAD.fields]))
    return coerce_payload(reader.load(path))


def split_by_dimension(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(usable vectors, quarantine): a wrong size or a missing value quarantines a vector."""
    ok = F.coalesce((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)),
                    F.lit(False))
    return vectors.filter(ok), vectors.filter(~ok)


def read_vectors(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    return split_by_dimension(spark.read.parquet(path), dim)


# MIME type of each accepted extension.
MIME_OF = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp"}


def describe_files(files: DataFrame) -> DataFrame:
    """File name, extension, MIME type, size and SHA-256 of (path, content) rows; other columns stay."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    pairs = [F.lit(x) for item in MIME_OF.items() for x in item]
    return files.select(
        *(c for c in files.columns if c != "content"), name.alias("file_name"), extension.alias("extension"),
        F.try_element_at(F.create_map(*pairs), extension).alias("mime_type"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.sha2(F.col("content"), 256).alias("checksum"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path)
    return describe_files(files)


def exact_copies(files: DataFrame) -> DataFrame:
    """Checksums held by more than one file, with how many and the first path."""
    return files.groupBy("checksum").agg(
        F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")
