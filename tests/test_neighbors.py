import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vitrine.operators.fusion import fuse, ranked, single_modality
from vitrine.operators.neighbors import _grid, _packs, _scored, _sides, knn_join, knn_lsh
from vitrine.plans.search import missing_vectors, search, self_neighbors, similar_products


def vectors(spark, path, m, **columns):
    data = {"product_id": pa.array(range(len(m))), "vector": pa.array(list(m), pa.list_(pa.float32())),
            **columns}
    pq.write_table(pa.table(data), str(path))
    return spark.read.parquet(str(path))


def brute(m, k, allowed=lambda i, j: True, self_too=False):
    u = m.astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    return {i: sorted((j for j in range(len(m)) if (self_too or j != i) and allowed(i, j)),
                      key=lambda j: (-s[i, j], j))[:k] for i in range(len(m))}


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["product_id"])
    return out


def skewed(n=600, d=16, seed=2):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, d))
    m[: n // 3] = m[0]  # a third are exact copies
    return m[rng.permutation(n)].astype("float32")


def queries(products, *extra):
    return products.withColumn("query_id", F.col("product_id")).select("query_id", "vector", *extra)


@pytest.mark.parametrize("cell_rows", [16_384, 200, 77])
def test_knn_is_exact_under_skew(spark, tmp_path, cell_rows):
    m = skewed()
    p = vectors(spark, tmp_path / "v.parquet", m)
    got = as_lists(knn_join(queries(p), p, 7, exclude_self=True, cell_rows=cell_rows))
    assert got == brute(m, 7)


@pytest.mark.parametrize("cell_rows", [16_384, 30])
def test_knn_filters_before_top_k(spark, tmp_path, cell_rows):
    m = skewed(300)
    brand = ["a" if i % 3 else f"b{i % 5}" for i in range(300)]
    price = [float(i % 50) if i % 7 else None for i in range(300)]
    p = vectors(spark, tmp_path / "v.parquet", m, brand_key=pa.array(brand),
                price=pa.array(price, pa.float64()))
    q = p.select(F.col("product_id").alias("query_id"), "vector",
                 F.when(F.col("product_id") % 2 == 0, F.col("brand_key")).alias("brand_key"),
                 F.when(F.col("product_id") % 5 == 0, F.lit(10.0)).alias("min_price"),
                 F.when(F.col("product_id") % 4 == 0, F.lit(30.0)).alias("max_price"))

    def allowed(i, j):
        if i % 2 == 0 and brand[i] != brand[j]:
            return False
        if i % 5 == 0 and (price[j] is None or price[j] < 10):
            return False
        return not (i % 4 == 0 and (price[j] is None or price[j] > 30))

    expected = {i: v for i, v in brute(m, 5, allowed, self_too=True).items() if v}
    assert as_lists(knn_join(q, p, 5, cell_rows=cell_rows)) == expected


def test_knn_within_group_and_string_ids(spark, tmp_path):
    m = skewed(200)
    group = [f"g{i % 4}" if i else None for i in range(200)]
    p = vectors(spark, tmp_path / "v.parquet", m, brand_key=pa.array(group))
    named = p.withColumn("product_id", F.lpad(F.col("product_id").cast("string"), 4, "0"))
    got = as_lists(knn_join(queries(named, "brand_key"), named, 3, within="brand_key", exclude_self=True))
    want = brute(m, 3, lambda i, j: group[i] is not None and group[i] == group[j])
    assert got == {f"{i:04d}": [f"{j:04d}" for j in v] for i, v in want.items() if v}


def test_lsh_recall(spark, tmp_path):
    m = skewed(500)
    p = vectors(spark, tmp_path / "v.parquet", m)
    exact = brute(m, 5)
    got = as_lists(knn_lsh(queries(p), p, 5, tables=10, bits=3, exclude_self=True))
    recall = np.mean([len(set(exact[i]) & set(got.get(i, []))) / 5 for i in exact])
    assert recall > 0.9
    assert all(len(v) == len(set(v)) for v in got.values())


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, product_id long, score double")


def test_fusion_scores(spark):
    image = hits(spark, [(1, 10, 1.0), (1, 11, 0.8)])
    text = hits(spark, [(1, 10, 0.5), (1, 12, 0.6)])
    got = {r["product_id"]: r for r in ranked(fuse(image, text), 10).collect()}
    assert got[10]["score"] == pytest.approx(0.7 + 0.15)
    assert got[11]["score"] == pytest.approx(0.56)
    assert got[12]["score"] == pytest.approx(0.18)
    assert got[10]["matched_modalities"] == ["image", "text"]
    assert [got[i]["rank"] for i in (10, 11, 12)] == [1, 2, 3]
    assert single_modality(hits(spark, [(1, 5, 0.83)]), "image").first()["score"] == 0.83


def test_search_modes_and_missing(spark, tmp_path):
    m = skewed(60)
    p = vectors(spark, tmp_path / "v.parquet", m)
    q = p.limit(3).select(
        F.col("product_id").alias("query_id"),
        F.when(F.col("product_id") != 1, F.col("vector")).alias("image_vector"),
        F.when(F.col("product_id") != 0, F.col("vector")).alias("text_vector"))
    best = {r["query_id"]: r for r in search(q, p, p, 4).filter("rank = 1").collect()}
    assert best[0]["matched_modalities"] == ["image"] and best[0]["score"] == pytest.approx(1.0)
    assert best[1]["matched_modalities"] == ["text"] and best[1]["score"] == pytest.approx(1.0)
    assert best[2]["score"] == pytest.approx(1.0)
    assert missing_vectors(p, p.filter("product_id <> 7")).first()["product_id"] == 7


def test_similar_needs_both_vectors(spark, tmp_path):
    p = vectors(spark, tmp_path / "v.parquet", skewed(50))
    image, text = self_neighbors(p.filter("product_id <> 3"), 5), self_neighbors(p, 5)
    got = similar_products(image, text, 5)
    assert got.filter("query_id = 3").count() == 0
    assert got.filter("query_id = product_id").count() == 0
    assert got.groupBy("query_id").count().agg(F.max("count")).first()[0] == 5


def test_a_key_with_most_rows_is_spread_over_many_cells(spark, tmp_path):
    m = skewed(600)
    key = pa.array(["hot" if i % 10 else f"cold{i % 7}" for i in range(600)])
    p = vectors(spark, tmp_path / "v.parquet", m, brand_key=key)
    rows = p.select(F.col("product_id"), "vector", F.col("brand_key").alias("within"))
    grid = {r["within"]: (r["q_blocks"], r["p_blocks"]) for r in _grid(rows, rows, 60).collect()}
    assert grid == {"hot": (9, 9)}
    packs = _packs(rows, _grid(rows, rows, 60), "product_id", ["product_id"], "p", "q").collect()
    cells = {(r["p_block"], r["q_block"]) for r in packs if r["within"] == "hot"}
    assert len(cells) == 81 and max(len(r["p_product_id"]) for r in packs) < 120
    got = as_lists(knn_join(queries(p, "brand_key"), p, 5, within="brand_key", exclude_self=True, cell_rows=60))
    keys = key.to_pylist()
    assert got == {i: x for i, x in brute(m, 5, lambda i, j: keys[i] == keys[j]).items() if x}


def test_more_probes_find_more(spark, tmp_path):
    m = np.random.default_rng(3).normal(size=(500, 24)).astype("float32")
    p = vectors(spark, tmp_path / "v.parquet", m)
    exact = brute(m, 10)
    share = []
    for probes in (1, 4, 16):
        got = as_lists(knn_lsh(queries(p), p, 10, tables=3, bits=4, probes=probes, exclude_self=True))
        share.append(sum(len(set(exact[i]) & set(got.get(i, []))) for i in exact) / 5000)
    assert share[0] < share[1] < share[2] == 1.0


def test_a_cell_gives_k_rows_for_a_query(spark, tmp_path):
    m = skewed(2500)  # three packs of either side in one cell
    p = vectors(spark, tmp_path / "v.parquet", m)
    price = p.withColumn("price", F.when(F.col("product_id") % 7 > 0, F.col("product_id") % 50))
    asked, offered, prices = _sides(queries(price, F.lit(10.0).alias("min_price")), price, None)
    found = _scored(asked, offered, 4, 16_384, prices)
    assert found.groupBy("query_id").count().agg(F.min("count"), F.max("count")).first()[:] == (4, 4)
    want = brute(m, 4, lambda i, j: j % 7 > 0 and j % 50 >= 10, self_too=True)
    got = {}
    for r in found.orderBy(F.desc("rank_score"), "product_id").collect():
        got.setdefault(r["query_id"], []).append(r["product_id"])
    assert got == want


def test_blocks_get_longer_instead_of_more(spark, tmp_path, monkeypatch):
    m = skewed(600)
    p = vectors(spark, tmp_path / "v.parquet", m)
    assert as_lists(knn_join(queries(p), p, 7, exclude_self=True, cell_rows=5)) == brute(m, 7)  # 120 x 15 of this length

    def counting(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"query_id": [0], "product_id": [b.num_rows], "score": [0.0], "rank_score": [0.0]})

        return run

    asked, offered, prices = _sides(queries(p), p, None)
    monkeypatch.setattr("vitrine.operators.neighbors._kernel", counting)
    # 16 blocks of queries for each of 4 of products and the other way round, a pack each.
    assert _scored(asked, offered, 3, 5, prices).agg(F.sum("product_id")).first()[0] == 128
    monkeypatch.setattr("vitrine.operators.neighbors.HELD_ROWS", 20)
    assert _grid(asked, offered, 5, 40, (16, 4)).first()[1:] == (30, 4)
