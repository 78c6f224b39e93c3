import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = ("facet_keys", "knn_filtered", "similar_by_product", "recommend", "duplicate_decisions",
          "price_trimmed", "merged_tags", "quota_hits", "trend_weekly", "rerank_diff", "job_state", "queue_stats", "knn_lsh_topk",
          "stream_daily_counts", "stream_rate_minute", "stream_trailing_counts", "zero_result_filters", "recommend_after_upsert",
          "duplicate_pairs_blocked", "fuzzy_matches", "ops_quantiles_trailing", "stream_quota_hits", "embed_model", "image_model",
          "read_products", "retrieve", "knn_lsh_recall")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "product_id", "score", "rank", "name"} <= set(rows[0].asDict())


def flat(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 8) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert flat([tuple(r) for r in frame.collect()], frame.columns) == flat(result.fetchall(), names)
