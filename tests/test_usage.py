import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vitrine.config import UsageConfig
from vitrine.operators import enrich as E
from vitrine.operators import evaluate as V
from vitrine.operators import images as I
from vitrine.operators import jobs as B
from vitrine.operators import registry as M
from vitrine.operators import usage as U


def events(spark, rows):
    return spark.createDataFrame(rows, "event_type string, ts timestamp, seconds double")


def day(n):
    return dt.datetime(2026, 1, n, 12)


def test_usage_and_report(spark):
    daily = U.daily_counters(events(spark, [
        ("upload", day(10), 2.0), ("upload", day(4), 4.0), ("upload", day(3), 9.0), ("search", day(9), None)]))
    row = U.usage(daily, "2026-01-10", 7).first()
    assert (row["upload"], row["search"], row["average_seconds"]) == (2, 1, 3.0)
    assert U.usage(daily, "2025-01-10", 7).first()["average_seconds"] == 0.0
    report = U.labeled_report(daily, "2026-01-10", 7, "week").first()
    assert report["start_date"] == dt.date(2026, 1, 4)
    board = U.dashboard(daily, "2026-01-10").first()
    assert (board["today_upload"], board["window_upload"]) == (1, 2)
    assert U.retained(daily, "2026-01-10", 1).count() == 1


def test_trend(spark):
    daily = U.daily_counters(events(spark, [("upload", day(10), None), ("upload", day(8), None), ("upload", day(8), None)]))
    points = U.trend(daily, "daily", 3, "2026-01-10").orderBy("period_start").collect()
    assert [p["value"] for p in points] == [2.0, 0.0, 1.0]
    weekly = U.trend(daily, "weekly", 2, "2026-01-10").orderBy("period_start").collect()
    assert [p["value"] for p in weekly] == [0.0, 3.0]
    text = U.trend_markdown(U.trend(daily, "daily", 1, "2026-01-10"), "daily").first()["markdown"]
    assert text == "# Upload trend (daily)\n\n| Period start | Value |\n|---|---|\n| 2026-01-10 | 1 |\n"
    trailing = {r["day"].day: r["trailing"] for r in U.trailing_usage(daily, 2).collect()}
    assert trailing == {8: 2, 9: 2, 10: 1}


def test_quota(spark):
    rows = [(i, "t" if i < 5 else "u", dt.datetime(2026, 1, 1, 0, i // 2, i)) for i in range(7)]
    requests = spark.createDataFrame(rows, "request_id long, tenant_id string, ts timestamp")
    got = {r["request_id"]: (r["daily_count"], r["minute_count"], r["verdict"])
           for r in U.quota_hits(requests, UsageConfig(daily_quota=4, minute_quota=1)).collect()}
    assert got[0] == (1, 1, None) and got[1] == (2, 2, "rate_limit") and got[2] == (3, 1, None)
    assert got[4] == (5, 1, "daily_quota") and got[5] == (1, 1, None)
    free = U.quota_hits(requests, UsageConfig(daily_quota=0, minute_quota=0))
    assert free.filter("verdict is not null").count() == 0


def test_audit_and_history(spark):
    log = spark.createDataFrame([("x", f"a{i}", i, day(i + 1)) for i in range(5)] + [("y", "b", 9, day(1))],
                                "tenant_id string, action string, event_id int, created_at timestamp")
    kept = U.recent_audit(log, UsageConfig(audit_cap=3)).filter("tenant_id = 'x'").orderBy("rank").collect()
    assert [r["action"] for r in kept] == ["a4", "a3", "a2"]
    searches = spark.createDataFrame([(1, "red", day(1)), (1, "red", day(3)), (1, "blue", day(2))],
                                     "user_id long, query string, at timestamp")
    assert [r["query"] for r in U.search_history(searches, ["query"]).orderBy("rank").collect()] == ["red", "blue"]


def test_job_states(spark):
    rows = [("ok", 1, False, "e", day(1)), ("ok", 2, True, None, day(2)), ("r", 1, False, "e1", day(1)),
            ("r", 2, False, "e2", day(2))] + [("dead", i, False, f"e{i}", day(i)) for i in range(1, 7)]
    rows += [("late", i, i == 8, None if i == 8 else f"e{i}", day(i)) for i in range(1, 9)]  # a success after the dead letter
    rows += [("again", 1, True, None, day(1)), ("again", 2, False, "e", day(2))]
    got = {r["job_id"]: r for r in B.job_state(spark.createDataFrame(
        rows, "job_id string, attempt int, success boolean, error string, completed_at timestamp")).collect()}
    assert (got["ok"]["status"], got["ok"]["error"], got["ok"]["retry_count"]) == ("completed", None, 1)
    assert (got["late"]["status"], got["late"]["error"], got["late"]["retry_count"]) == ("failed", "e6", 6)
    assert (got["again"]["status"], got["again"]["error"]) == ("completed", None)
    assert (got["r"]["status"], got["r"]["delay_seconds"], got["r"]["error"]) == ("retrying", 10.0, "e2")
    assert got["dead"]["status"] == "failed" and got["dead"]["dead_letter"]
    log = spark.createDataFrame([("a", "running", day(1), 1), ("b", "running", day(1), 2), ("b", "completed", day(1), 3)],
                                "job_id string, status string, at timestamp, event_id long")
    now = F.lit(day(1) + dt.timedelta(seconds=300))
    assert [r["job_id"] for r in B.stale_jobs(B.latest_status(log), now).collect()] == ["a"]


def test_one_active_model(spark):
    regs = spark.createDataFrame([("text", "1.0.0", "mini", "active", 1), ("text", "2.0.0", "large", "active", 2),
                                  ("text", "1.0.0", "again", "active", 9), ("image", "1.0.0", "vision", "active", 1)],
                                 "model_type string, version string, model_name string, status string, at int")
    none = spark.createDataFrame([], "model_type string, version string, action string, at int")
    active = M.current_models(regs, none).filter("status = 'active'")
    assert {(r["model_type"], r["version"], r["model_name"]) for r in active.collect()} == {
        ("text", "2.0.0", "large"), ("image", "1.0.0", "vision")}
    switch = spark.createDataFrame([("text", "1.0.0", "activate", 5), ("image", "1.0.0", "deactivate", 6),
                                    ("text", "9.9.9", "activate", 7)], none.schema)
    types = spark.createDataFrame([("text",), ("image",), ("rerank",)], "model_type string")
    got = {r["model_type"]: (r["active_version"], r["registered_versions"])
           for r in M.model_usage(types, M.current_models(regs, switch)).collect()}
    assert got == {"text": ("1.0.0", 2), "image": (None, 1), "rerank": (None, 0)}


def plain_metrics(ranked, expected, k):
    top = ranked[:k]
    rel = [x in expected for x in top]
    if not expected:
        return 0.0, 0.0, 0.0, 0.0
    dcg = sum(1 / math.log2(i + 2) for i, r in enumerate(rel) if r)
    idcg = sum(1 / math.log2(i + 2) for i in range(min(len(expected), k)))
    return (sum(rel) / len(top) if top else 0.0, sum(rel) / len(expected), dcg / idcg, float(any(rel)))


def test_metrics_equal_plain_definitions(spark):
    rng = random.Random(8)
    cases = {q: (rng.sample(range(30), rng.randint(0, 12)), set(rng.sample(range(30), rng.randint(0, 8)))) for q in range(40)}
    ranked = spark.createDataFrame([(q, p, i) for q, (r, _) in cases.items() for i, p in enumerate(r, 1)],
                                   "query_id long, product_id long, rank int")
    expected = spark.createDataFrame([(q, p) for q, (_, e) in cases.items() for p in e], "query_id long, product_id long")
    queries = spark.createDataFrame([(q,) for q in cases], "query_id long").join(
        V.expected_counts(expected), "query_id", "left").na.fill(0, ["n_expected"])
    for row in V.query_metrics(queries, V.flag_relevance(ranked, expected)).collect():
        r, e = cases[row["query_id"]]
        for k in V.CUTOFFS:
            got = tuple(row[f"{m}_at_{k}"] for m in ("precision", "recall", "ndcg", "hit_rate"))
            assert got == pytest.approx(plain_metrics(r, e, k))
        first = next((i for i, p in enumerate(r, 1) if p in e), None)
        assert row["reciprocal_rank"] == pytest.approx(1 / first if first else 0.0)


def test_task_summary_and_reports(spark, tmp_path):
    names = [*V.metric_names(), "reciprocal_rank"]
    schema = "task_type string, error string, latency_seconds double, " + ", ".join(f"{n} double" for n in names)
    rows = [("retrieval", None, 0.2, *[0.8] * len(names)), ("retrieval", "boom", 9.0, *[0.0] * len(names)),
            ("duplicate", "boom", 1.0, *[0.0] * len(names))]
    summary = V.task_metrics(spark.createDataFrame(rows, schema))
    got = {r["task_type"]: r for r in summary.collect()}
    assert got["retrieval"]["mrr"] == pytest.approx(0.8) and got["retrieval"]["failure_count"] == 1
    text = V.report_markdown(summary).collect()
    assert len(text) == 1 and "| 5 | 0.8000 | 0.8000 | 0.8000 | 0.8000 |" in text[0]["markdown"]
    assert "- Throughput: 1.50 queries/second" in V.report_header(summary, 2.0, "now").first()["markdown"]
    diff = V.report_difference(V.long_form(summary), V.long_form(summary.withColumn("mrr", F.lit(0.9))))
    assert "| MRR | 0.8000 | 0.9000 | +0.1000 |" in V.comparison_markdown(diff).first()["markdown"]
    V.write_report({"summary": summary}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/summary")).count() == 2


def test_merge_rules(spark):
    preds = spark.createDataFrame([(1, "color", "Red", 0.95, "text"), (1, "color", "Orange", 0.61, "image"),
                                   (1, "style", "Casual", 0.5, "text"), (2, "color", "Blue", 0.7, "image"),
                                   (2, "color", "Navy", 0.7, "text")],
                                  "product_id long, attribute string, value string, confidence double, source string")
    merged = {(r["product_id"], r["attribute"]): r for r in E.merge_attributes(preds).collect()}
    assert merged[1, "color"]["value"] == "Red" and merged[1, "color"]["conflict"]
    assert not merged[1, "style"]["accepted"] and merged[2, "color"]["value"] == "Navy"
    empty = spark.createDataFrame([(0.0, 0, 0, 0)], "confidence double, filled long, conflicts long, considered long")
    assert E.quality_score(empty).first()["quality_score"] == pytest.approx(0.2)
    tags = spark.createDataFrame([(1, "Red ", 0.8, "text", 0), (1, "red", 0.7, "image", 5), (1, "x", 0.5, "text", 1),
                                  (1, "b", 0.8, "text", 2)] + [(1, f"t{i:02d}", 0.6, "text", 10 + i) for i in range(30)],
                                 "product_id long, tag string, confidence double, source string, position int")
    rows = E.merge_tags(tags).orderBy("rank").collect()
    assert len(rows) == 20 and (rows[0]["tag"], rows[0]["source"]) == ("red", "hybrid") and rows[1]["tag"] == "b"


def image(spark, paint, side=50):
    rows = [("i", x, y, *paint(x, y)) for y in range(side) for x in range(side)]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int")
    size = spark.createDataFrame([("i", 1200, 900)], "image_id string, width int, height int")
    return pixels, I.image_statistics(pixels, size)


def box(subject, ground, x, y):
    return subject if 15 <= x < 35 and 15 <= y < 35 else ground


def test_image_statistics(spark):
    _, stats = image(spark, lambda x, y: box((44, 46, 52), (238, 240, 244), x, y))
    row = stats.first()
    assert (row["color_name"], row["brightness_bucket"]) == ("black", "dark")
    assert tuple(row["background"]) == (238, 240, 244) and row["subject_pixels"] == 400
    assert (row["orientation"], row["resolution"]) == ("landscape", "high_resolution")
    _, red = image(spark, lambda x, y: box((200, 30, 30), (245, 240, 220), x, y))
    assert I.image_predictions(red).first()["value"] == "Red"
    assert I.image_tags(red).count() == 4
    pixels, solid = image(spark, lambda x, y: (0, 128, 0))
    assert solid.first()["color_name"] == "green" and solid.first()["subject_pixels"] == 0
    v = I.color_histogram(pixels).first()["vector"]
    assert len(v) == 512 and max(v) == 1.0


@pytest.mark.parametrize("rgb, name", [((36, 82, 168), "blue"), ((24, 58, 122), "blue"), ((255, 255, 255), "white"),
                                       ((128, 128, 128), "gray"), ((255, 0, 4), "red"), ((10, 10, 12), "black")])
def test_color_names(spark, rgb, name):
    column = F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", rgb)])
    assert spark.range(1).select(I.color_name(column)).first()[0] == name
