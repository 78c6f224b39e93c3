"""What ``prepare`` bounds."""

import pytest
from pyspark.sql import functions as F

from vitrine.session import BROADCAST_BYTES, prepare

KEYS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def fresh(spark):
    session = spark.newSession()
    for key in KEYS:
        session.conf.unset(key)
    return session


def test_ids_of_a_large_table_are_not_broadcast(fresh, tmp_path):
    ids = fresh.range(200_000).select(F.xxhash64("id").alias("product_id"), F.md5(F.col("id").cast("string")).alias("name"))
    ids.coalesce(1).write.parquet(str(tmp_path / "part"))
    ids.withColumn("vector", F.array(*[F.rand(i) for i in range(8)])).write.parquet(str(tmp_path / "vectors"))

    def plan():
        part, vectors = (fresh.read.parquet(str(tmp_path / x)) for x in ("part", "vectors"))
        joined = vectors.join(part.select("product_id"), "product_id").select("product_id", "vector")
        return joined._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan()
    prepare(fresh)
    assert "BroadcastHashJoin" not in plan()


@pytest.mark.parametrize("limit, kept", [("-1", "-1"), ("256k", "256k"), ("10485760b", str(BROADCAST_BYTES)), ("1g", str(BROADCAST_BYTES))])
def test_smaller_limits_of_a_session_stay(fresh, limit, kept):
    for key in KEYS:
        fresh.conf.set(key, limit)
    prepare(fresh)
    assert [fresh.conf.get(key) for key in KEYS] == [kept, kept]
