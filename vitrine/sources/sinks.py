"""Upserts, deletes, caches and appended logs on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS


def latest(rows: DataFrame, key: str, *version: Column) -> DataFrame:
    """The newest row per key; Spark drops older rows before the shuffle."""
    order = Window.partitionBy(key).orderBy(*[v.desc() for v in version])
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, updates: DataFrame, key: str = "product_id",
           version: str = "version") -> DataFrame:
    """``table`` with rows of ``updates`` in place of equal keys; the last update of a key wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)),
                                                          allowMissingColumns=True)
    return latest(both, key, F.col("_new"), F.col(version)).drop("_new")


def delete(table: DataFrame, ids: DataFrame, key: str = "product_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def fresh_entries(cache: DataFrame, now: Column,
                  ttl_seconds: int = DEFAULTS.recommend.cache_ttl_seconds) -> DataFrame:
    """Cache rows still inside their time to live."""
    return cache.filter(F.timestamp_diff("SECOND", F.col("computed_at"), now) < ttl_seconds)


def to_recompute(wanted: DataFrame, cache: DataFrame, now: Column,
                 ttl_seconds: int = DEFAULTS.recommend.cache_ttl_seconds,
                 key: str = "product_id") -> DataFrame:
    """Wanted keys without a fresh cache row."""
    fresh = fresh_entries(cache, now, ttl_seconds).select(key)
    return wanted.join(fresh, key, "left_anti")


def invalidate(cache: DataFrame, changed: DataFrame, key: str = "for_product_id") -> DataFrame:
    """Cache rows of products that did not change and that recommend none that did."""
    ids = changed.select("product_id").distinct()
    stale = cache.join(ids, "product_id", "left_semi").select(key).unionByName(ids.withColumnRenamed("product_id", key))
    return cache.join(stale.distinct(), key, "left_anti")


#: Folders that the tenants of one day share in an appended log.
TENANT_BUCKETS = 16


def append_log(rows: DataFrame, path: str, at: str = "created_at", tenant: str = "tenant_id",
               buckets: int = TENANT_BUCKETS) -> None:
    """Appends to a log by day (where rows have ``at``) and tenant bucket: a reader of one tenant and day opens one folder, and a write makes
    ``buckets`` files a day at most, however many tenants there are."""
    dealt, folders = rows.withColumn("tenant_bucket", tenant_bucket(F.col(tenant), buckets)), ["tenant_bucket"]
    if at in rows.columns:
        dealt, folders = dealt.withColumn("day", F.to_date(at)), ["day", "tenant_bucket"]
    dealt.repartition(*folders).write.mode("append").partitionBy(*folders).parquet(path)


def tenant_bucket(tenant: Column, buckets: int = TENANT_BUCKETS) -> Column:
    """The bucket to ask for beside a tenant when a log is read."""
    return F.pmod(F.xxhash64(tenant.cast("string")), F.lit(buckets)).cast("int")
