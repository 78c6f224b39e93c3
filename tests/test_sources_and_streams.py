import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators.embed import fit_text_weights, hashed_text_vectors, model_embedder
from vitrine.operators import lookup as K
from vitrine.session import working_dir
from vitrine.sources import catalog as C
from vitrine.sources import sinks as W
from vitrine.sources.evaluation import DatasetError, load_dataset
from vitrine.streaming import upsert as SU
from vitrine.streaming import usage as ST


def test_payload_coercion(spark, tmp_path):
    spark.createDataFrame([("1", " ", "Nike", "abc")], "product_id string, name string, brand string, price string"
                          ).write.parquet(str(tmp_path / "p"))
    row = C.read_products(spark, str(tmp_path / "p")).first()
    assert row["name"] is None and row["price"] is None and row["tags"] == [] and row["brand_key"] == "nike"


def test_vector_quarantine(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")])],
                          "product_id long, vector array<float>").write.parquet(str(tmp_path / "v"))
    good, bad = C.read_vectors(spark, str(tmp_path / "v"), 2)
    assert [r[0] for r in good.select("product_id").collect()] == [1] and bad.count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    rows = {r["file_name"]: r for r in C.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.PNG"]["extension"] == ".png" and rows["a.PNG"]["mime_type"] == "image/png"
    assert rows["a.PNG"]["checksum"] == hashlib.sha256(b"abc").hexdigest() and rows["b.txt"]["mime_type"] is None
    assert C.exact_copies(C.read_files(spark, str(tmp_path))).first()["copies"] == 2


def dataset(tmp_path, content):
    path = tmp_path / "d.json"
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    return str(path)


def test_evaluation_dataset(spark, tmp_path):
    path = dataset(tmp_path, [{"query": "red shoe", "expected_products": ["a"]},
                              {"query_id": "r", "task_type": "recommendation", "product_id": "a", "top_k": 3},
                              {"text": "x", "query_id": ""}])
    rows = load_dataset(spark, path).orderBy("position").collect()
    assert [r["query_id"] for r in rows] == ["query-0", "r", "query-2"]
    assert rows[0]["text"] == "red shoe" and rows[0]["task_type"] == "retrieval" and rows[2]["expected_products"] == []


@pytest.mark.parametrize("content, message", [
    ([{"query": "ok"}, {"task_type": "duplicate"}], "entry #1 .query-1.: needs product_id"),
    ([{"query": " "}], "entry #0"), ([{"query": "x", "task_type": "other"}], "unknown task type"),
    ([{"query": "x", "top_k": 0}], "top_k"), ([3], "not a JSON object"), ({"query": "x"}, "not a JSON array")])
def test_bad_datasets_fail_loudly(spark, tmp_path, content, message):
    with pytest.raises(DatasetError, match=message):
        load_dataset(spark, dataset(tmp_path, content))


def test_lookups(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "product_id long, name string")
    asked = spark.createDataFrame([(7, 2, 0), (7, 9, 1), (7, 2, 2), (7, 1, 3)], "request_id long, product_id long, position int")
    got = K.batch_resolve(asked, table).orderBy("position").collect()
    assert [(r["product_id"], r["found"]) for r in got] == [(2, True), (9, False), (1, True)]
    assert K.retrieve(asked, table).count() == 3


def test_upsert_and_delete(spark):
    table = spark.createDataFrame([(1, "old", 9), (2, "keep", 1)], "product_id long, name string, version int")
    new = spark.createDataFrame([(1, "n1", 1), (1, "n2", 2), (3, "add", 1)], table.schema)
    got = {r["product_id"]: r["name"] for r in W.upsert(table, new).collect()}
    assert got == {1: "n2", 2: "keep", 3: "add"}
    assert W.upsert(table, new.filter("false")).count() == 2
    assert W.delete(table, new).count() == 1


def test_cache_ttl(spark, tmp_path):
    now = F.lit(dt.datetime(2026, 1, 1, 12))
    cache = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 11, 30)), (2, dt.datetime(2026, 1, 1, 11, 0))],
                                  "product_id long, computed_at timestamp")
    assert [r[0] for r in W.fresh_entries(cache, now).select("product_id").collect()] == [1]
    assert [r[0] for r in W.to_recompute(spark.range(1, 4).withColumnRenamed("id", "product_id"), cache, now)
            .orderBy("product_id").collect()] == [2, 3]
    W.append_log(cache.withColumn("tenant_id", F.lit("t")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_text_and_model_embedders(spark):
    frame = spark.createDataFrame([(1, "red shoe"), (2, "shoe red"), (3, "blue lamp")], "product_id long, text string")
    v = {r["product_id"]: np.array(r["vector"]) for r in hashed_text_vectors(frame, fit_text_weights(frame)).collect()}
    assert np.allclose(v[1], v[2]) and np.isclose(np.linalg.norm(v[3]), 1, atol=1e-6) and len(v[1]) == 384

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    unit = frame.select(model_embedder(load, 2)(F.col("text")).alias("v")).first()["v"]
    assert np.isclose(np.linalg.norm(unit), 1)


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def write_events(spark, folder, rows):
    data = [(i, ts, u, t, 1.5, "{}") for i, (ts, u, t) in enumerate(rows)]
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_stream_counters_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "ev")
    at = dt.datetime(2026, 1, 1)
    rows = [(at + dt.timedelta(hours=5 * i), i % 3, "view" if i % 2 else "click") for i in range(40)]
    write_events(spark, folder, rows)
    got = ST.run_updates(ST.daily_counters(ST.read_events(spark, folder, "*.parquet")), "t-daily", "day", "event_type")
    batch = {}
    for ts, _, kind in rows:
        batch[ts.date(), kind] = batch.get((ts.date(), kind), 0) + 1
    assert {(r["day"], r["event_type"]): r["n"] for r in got.collect()} == batch
    twice = ST.read_events(spark, folder, "*.parquet").withColumn("c", F.explode(F.array(F.lit(1), F.lit(2))))
    assert ST.run_available(ST.once_per_id(twice.drop("c")), "t-dedup").count() == 40


def test_stream_upsert_converges_and_gates(spark, tmp_path):
    folder = str(tmp_path / "ev")
    at = dt.datetime(2026, 1, 1)
    write_events(spark, folder, [(at, 1, "a"), (at, 1, "b"), (at, 2, "c")])

    def rows():
        return ST.read_events(spark, folder, "*.parquet").select(
            F.col("user_id").alias("product_id"), F.col("event_id").alias("version"), "event_type")

    base = working_dir(spark, "t-upsert")
    SU.start_upsert(rows(), f"{base}/t", f"{base}/c").awaitTermination()
    write_events(spark, folder, [(at, 5, "d"), (at, 6, "e"), (at, 7, "f"), (at, 2, "g")])
    SU.start_upsert(rows(), f"{base}/t", f"{base}/c").awaitTermination()
    schema = rows().schema
    table = SU.current(spark, f"{base}/t", schema)
    assert {r["product_id"]: r["event_type"] for r in table.collect()} == {
        1: "b", 2: "g", 5: "d", 6: "e", 7: "f"}
    SU.write_batch(table.filter("product_id = 5"), 1, f"{base}/again", "product_id", "version")
    SU.write_batch(table.filter("product_id = 5"), 1, f"{base}/again", "product_id", "version")
    assert SU.current(spark, f"{base}/again", schema).count() == 1
    SU.compact(table, f"{base}/compact")
    assert SU.current(spark, f"{base}/compact", schema).count() == 5

    def find(batch):
        return batch.select(F.col("product_id").alias("query_id"), (F.col("product_id") == 1).alias("is_duplicate"),
                            F.lit(2).cast("long").alias("matched_product"), F.lit(0.95).alias("confidence"))

    gated = working_dir(spark, "t-gate")
    SU.start_upsert(rows(), f"{gated}/t", f"{gated}/c", prepare=SU.gate_with(find, "block")).awaitTermination()
    assert sorted(r["product_id"] for r in SU.current(spark, f"{gated}/t", schema).collect()) == [2, 5, 6, 7]
