"""The duplicate gate, quota state, sketches, maintained neighbors, routed evaluation and the logs behind them."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.config import DuplicateConfig, JobConfig, UsageConfig
from vitrine.operators import jobs, usage
from vitrine.operators.maintain import refresh_neighbors
from vitrine.plans.evaluation import checked_entries, evaluate_entries
from vitrine.plans.search import self_neighbors
from vitrine.session import materialize, working_dir
from vitrine.sources import sinks
from vitrine.sources.evaluation import parse_dataset
from vitrine.streaming import gate, quota

# ---------------------------------------------------------------- gate


def greedy(places, links, settled):
    accepted = []
    for i in sorted(places, key=places.get):
        if i not in settled and not any((j, i) in links for j in accepted):
            accepted.append(i)
    return accepted


def test_first_wins_equals_one_by_one(spark):
    rng = random.Random(8)
    ids = list(range(60))
    links = {(i, j) for i in ids for j in ids if i < j and rng.random() < 0.06} | {(i, i + 1) for i in range(40, 50)}
    settled = {3, 41}
    rows = spark.createDataFrame([(i, i) for i in ids], "product_id long, place long")
    got = gate.first_wins(rows, spark.createDataFrame(list(links), "earlier long, later long"),
                          spark.createDataFrame([(i,) for i in settled], "product_id long")).collect()
    assert sorted(r[0] for r in got) == ids
    assert sorted(r[0] for r in got if r[1]) == greedy({i: i for i in ids}, links, settled)


SHAPE = ("product_id long, name string, brand string, category string, color string, material string, style string, "
         "gender string, image_vector array<double>, text_vector array<double>")


def item(i, group, noise=0.0):
    rng = np.random.default_rng(group)
    image, text = rng.normal(size=5), rng.normal(size=4)
    return (i, f"name {group}", f"brand {group}", f"kind {group}", None, None, None, None, (image + noise).tolist(), text.tolist())


def test_a_batch_run_again_gives_the_same_rows(spark):
    cfg = DuplicateConfig(threshold=0.9)
    catalog = spark.createDataFrame([item(1, 1), item(2, 2)], SHAPE)
    shape = SHAPE + ", place long"
    first = spark.createDataFrame([item(10, 1) + (2,), item(11, 3) + (1,), item(12, 3) + (3,), item(13, 4) + (4,), item(2, 2) + (5,)], shape)
    second = spark.createDataFrame([item(20, 4) + (1,), item(21, 5) + (2,), item(22, 5) + (3,), item(12, 6) + (4,)], shape)
    path = working_dir(spark, "gate-test")

    def state():
        return sorted((r.batch_id, r.product_id, r.is_duplicate, r.matched_product, r.accepted) for r in gate.decisions(spark, path).collect())

    gate.run_batch(first, 0, catalog, path, "block", cfg)
    gate.run_batch(second, 1, catalog, path, "block", cfg)
    want = [(0, 2, False, None, True), (0, 10, True, 1, False), (0, 11, False, None, True), (0, 12, True, 11, False),
            (0, 13, False, None, True), (1, 12, False, None, True), (1, 20, True, 13, False), (1, 21, False, None, True),
            (1, 22, True, 21, False)]
    assert state() == want
    gate.run_batch(second, 1, catalog, path, "block", cfg)  # retried
    assert state() == want
    assert {tuple(r)[1:] for r in gate.judge_batch(first, catalog, "off", cfg).collect()} == {(False, None, 0.0, True)}
    with pytest.raises(ValueError):
        gate.judge_batch(first, catalog, "other", cfg)


# ---------------------------------------------------------------- quotas


def requests(*rows):
    return [(i, t, dt.datetime(2026, 1, 1, 12, m, s)) for i, t, m, s in rows]


def deliver(spark, base, rows):
    spark.createDataFrame(rows, "request_id long, tenant_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema("request_id long, tenant_id long, ts timestamp").parquet(f"{base}/in")


def test_stream_quota_counts_on_over_batches_until_state_expires(spark):
    cfg = UsageConfig(daily_quota=4, minute_quota=2)
    base = working_dir(spark, "quota-test")
    quota.run(deliver(spark, base, requests((1, 7, 0, 1), (2, 7, 0, 2), (3, 8, 0, 1))), f"{base}/q", cfg)
    out = quota.run(deliver(spark, base, requests((4, 7, 0, 3), (5, 7, 1, 0), (6, 7, 1, 1))), f"{base}/q", cfg)
    got = {r.request_id: (r.minute_count, r.daily_count, r.verdict) for r in out.collect()}
    assert got == {1: (1, 1, None), 2: (2, 2, None), 3: (1, 1, None), 4: (3, 3, "rate_limit"), 5: (1, 4, None), 6: (2, 5, "daily_quota")}

    base = working_dir(spark, "quota-test")
    short = {"minute_ttl": 500, "day_ttl": 3_600_000}
    quota.run(deliver(spark, base, requests((1, 7, 0, 1), (2, 7, 0, 2))), f"{base}/q", cfg, **short)
    time.sleep(1)
    out = quota.run(deliver(spark, base, requests((3, 7, 0, 3))), f"{base}/q", cfg, **short)
    assert {(r.minute_count, r.daily_count) for r in out.where("request_id = 3").collect()} == {(1, 3)}


def test_quota_numbers_of_a_busy_tenant(spark):
    rng = random.Random(2)
    rows = [(i, 1 if rng.random() < 0.9 else rng.randint(2, 5), dt.datetime(2026, 1, 1 + rng.randint(0, 1), 12, rng.randint(0, 3), rng.randint(0, 9)))
            for i in range(600)]
    got = {r.request_id: (r.minute_count, r.daily_count) for r in usage.quota_hits(
        spark.createDataFrame(rows, "request_id long, tenant_id long, ts timestamp")).collect()}
    want, minutes, days = {}, {}, {}
    for i, t, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        m, d = (t, ts.replace(second=0)), (t, ts.date())
        minutes[m], days[d] = minutes.get(m, 0) + 1, days.get(d, 0) + 1
        want[i] = minutes[m], days[d]
    assert got == want


# ---------------------------------------------------------------- sketches


def test_trailing_quantiles_keep_the_rank_error(spark):
    rng = np.random.default_rng(4)
    rows = [("a", dt.datetime(2026, 1, 1 + int(d)), float(v)) for d, v in zip(rng.integers(0, 5, 60_000), rng.lognormal(size=60_000))]
    ops = spark.createDataFrame(rows, "label string, ts timestamp, value double")
    at = [0.01, 0.5, 0.9, 0.99]
    got = usage.trailing_quantiles(usage.daily_sketches(ops), 3, at).collect()
    assert len(got) == 5
    for r in got:
        inside = np.sort([v for _, ts, v in rows if 0 <= (r.day - ts.date()).days < 3])
        assert r.n == len(inside)
        for q, value in zip(at, r.quantiles):
            assert abs(np.searchsorted(inside, value, side="right") / len(inside) - q) < 0.01


# ---------------------------------------------------------------- maintained neighbors


@pytest.mark.parametrize("seed", [1, 2])
def test_refreshed_neighbors_equal_recomputed_ones(spark, seed):
    rng = np.random.default_rng(seed)
    m = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(90)}  # many ties
    after = {i: v for i, v in m.items() if i % 11}
    after |= {5: [1.0, 0.0, 0.0, 0.0], 6: [0.0, 1.0, 0.0, 0.0], 200: [1.0, 1.0, 1.0, 1.0], 201: m[7]}
    changed = [i for i in {*m, *after} if m.get(i) != after.get(i)]
    shape = "product_id long, vector array<double>"
    stored = materialize(self_neighbors(spark.createDataFrame(list(m.items()), shape), 6), "lists")
    vectors = spark.createDataFrame(list(after.items()), shape)
    got = refresh_neighbors(stored, vectors, spark.createDataFrame([(i,) for i in changed], "product_id long"), 7).collect()
    want = {(r.query_id, r.product_id, r["rank"]) for r in self_neighbors(vectors, 6).collect()}
    assert {(r.query_id, r.product_id, r["rank"]) for r in got} == want and len(got) == len(want)
    assert {r.how for r in got} == {"kept", "merged", "redone"}


# ---------------------------------------------------------------- evaluation by task


def test_an_entry_or_route_that_fails_leaves_the_others_alone(spark):
    document = """[{"query_id": "a", "text": "x", "expected_products": ["1", "2"]}, {"query_id": "b", "task_type": "recommendation",
      "product_id": "9"}, {"query_id": "c", "task_type": "duplicate", "product_id": "1", "expected_products": ["2"]}, "junk",
      {"query_id": "d", "task_type": "recommendation", "product_id": "1", "expected_products": ["3"]}, {"query_id": "e", "text": " "}]"""
    parsed = parse_dataset(spark.createDataFrame([(document,)], "value string"))
    indexed = spark.createDataFrame([(1,), (2,)], "product_id long")

    def found(entries):
        return entries.select("query_id", F.lit("1").alias("product_id"), F.lit(1).alias("rank"))

    def broken(entries):
        raise RuntimeError("no index")

    rows = {r.query_id: r for r in evaluate_entries(checked_entries(parsed, indexed), {
        "retrieval": found, "duplicate": broken, "recommendation": found}).collect()}
    errors = {k: r.error for k, r in rows.items()}
    assert errors == {"a": None, "b": "product 9 is not indexed", "c": "RuntimeError: no index", "query-3": "not a JSON object",
                      "d": None, "e": "needs text or image_path"}
    assert rows["a"].precision_at_1 == 1.0 and rows["a"].recall_at_5 == 0.5 and rows["d"].recall_at_1 == 0.0
    some = evaluate_entries(checked_entries(parsed, indexed, ids=["d", "a", "c"], limit=2), {"retrieval": found}).collect()
    assert {(r.query_id, r.error) for r in some} == {("a", None), ("c", "no route for duplicate")}
    assert len(some) == 2


# ---------------------------------------------------------------- jobs and logs


def test_job_state_equals_one_attempt_after_the_other(spark):
    rng = random.Random(6)
    rows = [(j, a, rng.random() < 0.15, f"e{a}", dt.datetime(2026, 1, 1, 0, a % 60)) for j in range(30) for a in range(rng.randint(1, 14))]
    cfg = JobConfig(max_retries=3)
    got = {r.job_id: (r.attempts, r.retry_count, r.status, r.error) for r in jobs.job_state(spark.createDataFrame(
        rows, "job_id long, attempt int, success boolean, error string, completed_at timestamp"), cfg).collect()}
    want = {}
    for j in range(30):
        failures, status, error, last = 0, "retrying", None, None
        for _, a, ok, e, _ in sorted(r for r in rows if r[0] == j):
            last = a
            if ok:
                status, error = "completed", None
                break
            failures, error = failures + 1, e
            if failures > 3:
                status = "failed"
                break
        want[j] = (last, failures, status, error)
    assert got == want


def test_log_folders_do_not_grow_with_tenants(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").cast("string").alias("tenant_id"), F.lit(dt.datetime(2026, 1, 2)).alias("created_at"))
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows.limit(10), str(tmp_path / "log"))
    files = list((tmp_path / "log").rglob("*.parquet"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 510 and len(files) <= 2 * sinks.TENANT_BUCKETS
    one = log.where((F.col("tenant_bucket") == sinks.tenant_bucket(F.lit("7"))) & (F.col("tenant_id") == "7"))
    assert one.count() in (1, 2)


def test_invalidate_gives_up_what_a_change_touches(spark):
    cache = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 7), (8, 9)], "for_product_id long, product_id long")
    left = sinks.invalidate(cache, spark.createDataFrame([(3,), (6,)], "product_id long"))
    assert sorted(map(tuple, left.collect())) == [(4, 5), (8, 9)]
