"""Similarity search, recommendation, duplicate, pricing, evaluation and explanation queries."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import functions as F

from registry import frames as T
from registry import sql as S
from registry.core import query
from vitrine.config import DEFAULTS, DuplicateConfig, PricingConfig, VerifyConfig
from vitrine.functions import scalars as N
from vitrine.functions.fuzzy import sorted_tokens, token_similarity
from vitrine.operators import duplicates as D
from vitrine.operators import evaluate as V
from vitrine.operators import explain as X
from vitrine.operators.blocked import duplicate_pairs
from vitrine.operators.fuzzy_join import similar_values
from vitrine.operators.maintain import refresh_neighbors, refresh_recommendations
from vitrine.operators import filters as L
from vitrine.operators import images as I
from vitrine.operators import pricing as P
from vitrine.operators import recommend as R
from vitrine.operators.neighbors import hyperplanes, knn_join, knn_lsh
from vitrine.operators.pairs import compare_fields, hydrate
from vitrine.operators.models import word_overlap_model
from vitrine.operators.rerank import model_scorer, rerank
from vitrine.plans import catalog_jobs as J
from vitrine.plans.evaluation import evaluate_dataset as evaluate_by_task
from vitrine.plans.search import search, search_reranked, self_neighbors, similar_products
from vitrine.session import materialize, working_dir
from vitrine.sources.evaluation import parse_dataset
from vitrine.sources import sinks as W
from vitrine.streaming import gate as G

# The supplied vectors are far apart and prices vary little, so some limits are set where both
# outcomes occur.
PRICING = PricingConfig(top_k=50, min_similarity=0.15)
DUPLICATE = DuplicateConfig(threshold=0.62)
VERIFY = VerifyConfig(cross_encoder_threshold=0.7, require_same_brand=True)
CFG = replace(DEFAULTS, pricing=PRICING, duplicate=DUPLICATE, verify=VERIFY)


def round_columns(df, *names, digits=6):
    return df.withColumns({n: N.rounded(F.col(n), digits) for n in names})


def self_queries(vectors, *columns):
    return vectors.withColumn("query_id", F.col("product_id")).select("query_id", "vector", *columns)


def _both(spark, sf, depth):
    return (self_neighbors(T.image_vectors(spark, sf), depth),
            self_neighbors(T.text_vectors(spark, sf), depth))


def _similar(spark, sf, k):
    return similar_products(*_both(spark, sf, k), k)


# ---------------------------------------------------------------- search


@query(f"""WITH {S.vectors('vf', 1, 64)}, {S.neighbors('n', 'vf', 11)} SELECT query_id, product_id,
  {S.r('score', 6)} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS INTEGER)
  AS rank FROM n WHERE query_id <> product_id QUALIFY rank <= 10""")
def knn_topk(spark, sf):
    vectors = T.full_vectors(spark, sf)
    return round_columns(knn_join(self_queries(vectors), vectors, 10, exclude_self=True), "score")


@query(f"""WITH {S.CATALOG}, {S.vectors('vf', 1, 64)}, h AS (SELECT q.product_id AS query_id, p.product_id,
  list_inner_product(q.v, p.v) / (q.norm * p.norm) AS score FROM vf q JOIN vf p ON q.product_id <> p.product_id
  JOIN catalog cq ON cq.product_id = q.product_id JOIN catalog cp ON cp.product_id = p.product_id
  AND cp.brand_key = cq.brand_key)
  SELECT query_id, h.product_id, c.name, {S.r('score', 6)} AS score, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, h.product_id) AS INTEGER) AS rank FROM h JOIN catalog c ON c.product_id = h.product_id
  QUALIFY rank <= 10""")
def knn_within_brand(spark, sf):
    vectors = T.full_vectors(spark, sf)
    hits = knn_join(self_queries(vectors, "brand_key"), vectors, 10, within="brand_key",
                    exclude_self=True)
    return round_columns(hydrate(hits, T.catalog(spark, sf), ["name"]), "score")


FILTERED = f"""{S.CATALOG}, {S.vectors('vf', 1, 64)},
fq AS (SELECT c.product_id AS query_id, v, norm, CASE WHEN p_size % 2 = 0 THEN brand_key END AS bk,
  CASE WHEN p_size % 9 = 0 THEN 'no-such-category' WHEN p_size % 3 = 0 THEN category_key END AS ck,
  CASE WHEN p_size % 5 = 0 THEN price - 20 END AS lo, CASE WHEN p_size % 5 < 2 THEN price + 20 END AS hi
  FROM catalog c JOIN vf ON vf.product_id = c.product_id),
hits AS (SELECT query_id, p.product_id, list_inner_product(q.v, p.v) / (q.norm * p.norm) AS score FROM fq q
  JOIN (SELECT vf.*, brand_key, category_key, price FROM vf JOIN catalog USING (product_id)) p
  ON (bk IS NULL OR bk = p.brand_key) AND (ck IS NULL OR ck = p.category_key)
  AND (lo IS NULL OR p.price >= lo) AND (hi IS NULL OR p.price <= hi)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, p.product_id) <= 10)"""


@query(f"""WITH {FILTERED} SELECT query_id, product_id, {S.r('score', 6)} AS score FROM hits""")
def knn_filtered(spark, sf):
    hits = knn_join(T.filtered_queries(spark, sf), T.full_vectors(spark, sf), 10)
    return round_columns(hits, "score").drop("rank")


@query(f"""WITH {FILTERED} SELECT query_id, bk AS brand_key, ck AS category_key FROM fq
  WHERE query_id NOT IN (SELECT query_id FROM hits) AND (bk IS NOT NULL OR ck IS NOT NULL OR lo IS NOT NULL OR hi IS NOT NULL)""")
def zero_result_filters(spark, sf):
    queries = T.filtered_queries(spark, sf)
    hits = knn_join(queries, T.full_vectors(spark, sf), 10)
    return L.zero_result_filters(queries, hits).select("query_id", "brand_key", "category_key")


LSH = {"tables": 4, "bits": 4, "seed": 7, "probes": 6}


def _lsh_sql(cte: str, of: str, depth: int, dims: int) -> str:
    """Products in one of the cells probed for the query in some table; the planes are written out."""
    planes = hyperplanes(LSH["tables"], LSH["bits"], dims, LSH["seed"])
    margins = ", ".join(
        "[" + ", ".join(f"list_inner_product(v, {[float(x) for x in plane]})" for plane in table) + f"] AS m{t}"
        for t, table in enumerate(planes))
    own = ", ".join("(" + " + ".join(f"(m{t}[{i + 1}] > 0)::INT * {1 << i}" for i in range(LSH["bits"])) + f") AS c{t}"
                    for t in range(LSH["tables"]))
    away = " + ".join(f"(m // {1 << i} % 2) * margin[{i + 1}] ** 2" for i in range(LSH["bits"]))
    long = " UNION ALL ".join(f"SELECT product_id, {t} AS t, c{t} AS own, m{t} AS margin FROM {cte}_s" for t in range(LSH["tables"]))
    return f"""{cte}_s AS MATERIALIZED (SELECT *, {own} FROM (SELECT *, {margins} FROM {of})),
{cte}_t AS MATERIALIZED ({long}),
{cte}_p AS MATERIALIZED (SELECT product_id, t, xor(own, m) AS cell FROM {cte}_t, (SELECT unnest(range({1 << LSH['bits']}))::INT AS m)
  QUALIFY row_number() OVER (PARTITION BY product_id, t ORDER BY round({away}, 9), m) <= {LSH['probes']}),
{cte}_m AS MATERIALIZED (SELECT DISTINCT q.product_id AS a, p.product_id AS b FROM {cte}_p q JOIN {cte}_t p ON q.t = p.t AND q.cell = p.own),
{cte} AS (SELECT a AS query_id, b AS product_id, list_inner_product(q.v, p.v) / (q.norm * p.norm) AS score
  FROM {cte}_m JOIN {of} q ON q.product_id = a JOIN {of} p ON p.product_id = b
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) <= {depth})"""


@query(f"""WITH {S.vectors('vf', 1, 64)}, {_lsh_sql('n', 'vf', 11, 64)} SELECT query_id, product_id,
  {S.r('score', 6)} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS INTEGER)
  AS rank FROM n WHERE query_id <> product_id QUALIFY rank <= 10""")
def knn_lsh_topk(spark, sf):
    vectors = T.full_vectors(spark, sf)
    return round_columns(knn_lsh(self_queries(vectors), vectors, 10, **LSH, exclude_self=True), "score")


@query(f"""WITH {S.vectors('vf', 1, 64)}, {_lsh_sql('n', 'vf', 11, 64)}, {S.neighbors('x', 'vf', 11)},
  f AS (SELECT query_id, product_id FROM n WHERE query_id <> product_id QUALIFY row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, product_id) <= 10), w AS (SELECT query_id, product_id FROM x WHERE query_id <> product_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) <= 10)
  SELECT count(*) AS wanted, count(f.query_id) AS found, {S.r('count(f.query_id) / count(*)::DOUBLE', 6)} AS recall
  FROM w LEFT JOIN f USING (query_id, product_id)""")
def knn_lsh_recall(spark, sf):
    """How many of the exact ten nearest the approximate join returns."""
    vectors = T.full_vectors(spark, sf)
    queries = self_queries(vectors)
    exact = knn_join(queries, vectors, 10, exclude_self=True).select("query_id", "product_id")
    near = knn_lsh(queries, vectors, 10, **LSH, exclude_self=True).select("query_id", "product_id", F.lit(True).alias("seen"))
    return exact.join(near, ["query_id", "product_id"], "left").agg(
        F.count("*").alias("wanted"), F.count("seen").alias("found"),
        N.rounded(F.count("seen") / F.count("*"), 6).alias("recall"))


def _mixed_queries(spark, sf):
    """Queries by image, by text or by both, depending on the label."""
    rows = T.table(spark, sf, "embeddings").join(
        T.table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"), "p_name"), "vec_id")
    return rows.select(
        F.col("vec_id").alias("query_id"),
        F.when(F.col("label") != 1, F.slice("embedding", 1, 32)).alias("image_vector"),
        F.when(F.col("label") != 2, F.slice("embedding", 33, 32)).alias("text_vector"),
        F.col("p_name").alias("query_text"), "label")


def _mixed_sql(k):
    return f"""{S.vectors('vi', 1, 32)}, {S.vectors('vt', 33, 64)}, {S.neighbors('ni0', 'vi', k)}, {S.neighbors('nt0', 'vt', k)},
lab AS (SELECT vec_id AS query_id, label FROM embeddings),
ni AS (SELECT ni0.* FROM ni0 JOIN lab USING (query_id) WHERE label <> 1),
nt AS (SELECT nt0.* FROM nt0 JOIN lab USING (query_id) WHERE label <> 2),
fused AS (SELECT coalesce(i.query_id, t.query_id) AS query_id, coalesce(i.product_id, t.product_id) AS product_id,
  coalesce(i.score, 0) AS image_score, coalesce(t.score, 0) AS text_score,
  concat_ws(',', CASE WHEN i.score IS NOT NULL THEN 'image' END, CASE WHEN t.score IS NOT NULL THEN 'text' END) AS modalities
  FROM ni i FULL JOIN nt t ON i.query_id = t.query_id AND i.product_id = t.product_id),
pool AS (SELECT * FROM (SELECT query_id, product_id, image_score, text_score, modalities, CASE label WHEN 1 THEN text_score WHEN 2 THEN image_score
  ELSE 0.7 * image_score + 0.3 * text_score END AS score, label FROM fused JOIN lab USING (query_id))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) <= {k})"""


@query(f"""WITH {_mixed_sql(10)} SELECT query_id, product_id, {S.r('score', 6)} AS score,
  {S.r('image_score', 6)} AS image_score, {S.r('text_score', 6)} AS text_score, modalities FROM pool""")
def hybrid_search(spark, sf):
    hits = search(_mixed_queries(spark, sf), T.image_vectors(spark, sf), T.text_vectors(spark, sf), 10)
    hits = hits.withColumn("modalities", F.array_join("matched_modalities", ","))
    return round_columns(hits, "score", "image_score", "text_score").drop("matched_modalities", "rank")


def _filtered_side(name, source, skip):
    """Top 10 of one side for the queries that have it, within each query's filters."""
    return f"""{name} AS (SELECT q.product_id AS query_id, p.product_id, list_inner_product(q.v, p.v) / (q.norm * p.norm) AS score
  FROM {source} q JOIN fq ON fq.query_id = q.product_id JOIN lab ON lab.query_id = q.product_id AND label <> {skip}
  JOIN (SELECT s.*, brand_key, category_key, price FROM {source} s JOIN catalog USING (product_id)) p
  ON (bk IS NULL OR bk = p.brand_key) AND (ck IS NULL OR ck = p.category_key)
  AND (lo IS NULL OR p.price >= lo) AND (hi IS NULL OR p.price <= hi)
  QUALIFY row_number() OVER (PARTITION BY q.product_id ORDER BY round(score, 9) DESC, p.product_id) <= 10)"""


@query(f"""WITH {FILTERED}, {S.vectors('vi', 1, 32)}, {S.vectors('vt', 33, 64)}, lab AS (SELECT vec_id AS query_id, label FROM embeddings),
{_filtered_side('ni', 'vi', 1)}, {_filtered_side('nt', 'vt', 2)},
fused AS (SELECT coalesce(i.query_id, t.query_id) AS query_id, coalesce(i.product_id, t.product_id) AS product_id,
  coalesce(i.score, 0) AS image_score, coalesce(t.score, 0) AS text_score
  FROM ni i FULL JOIN nt t ON i.query_id = t.query_id AND i.product_id = t.product_id)
SELECT query_id, product_id, {S.r('score', 6)} AS score FROM (SELECT query_id, product_id, CASE label WHEN 1 THEN text_score
  WHEN 2 THEN image_score ELSE 0.7 * image_score + 0.3 * text_score END AS score FROM fused JOIN lab USING (query_id))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) <= 10""")
def hybrid_search_filtered(spark, sf):
    """Search by image, text or both, each query with its own mix of filters on both sides."""
    filters = T.filtered_queries(spark, sf).drop("vector")
    queries = _mixed_queries(spark, sf).join(filters, "query_id")
    hits = search(queries, T.image_vectors(spark, sf), T.text_vectors(spark, sf), 10)
    return round_columns(hits, "score").select("query_id", "product_id", "score")


def _logit(a, b):
    def words(x):
        return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''))"

    return (f"(8.0::DOUBLE * len(list_intersect({words(a)}, {words(b)})) / "
            f"len(list_distinct(list_concat({words(a)}, {words(b)}))) - 4.0::DOUBLE)")


SIGMOID = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)))"


@query(f"""WITH {S.CATALOG}, {_mixed_sql(50)}, p AS (SELECT pool.*, row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, pool.product_id) AS rk, {_logit('q.p_name', "concat_ws('. ', c.name, c.brand, c.category)")} AS logit
  FROM pool JOIN catalog c ON c.product_id = pool.product_id JOIN part q ON q.p_partkey = pool.query_id)
  SELECT query_id, product_id, CASE WHEN label = 2 THEN {S.r('score', 6)} ELSE {S.r(SIGMOID, 6)} END AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN label <> 2 THEN round(logit, 9) END DESC, rk) AS INTEGER) AS rank
  FROM p QUALIFY rank <= 10""")
def hybrid_search_reranked(spark, sf):
    hits = search_reranked(
        _mixed_queries(spark, sf), T.image_vectors(spark, sf), T.text_vectors(spark, sf),
        J.product_texts(T.indexed(spark, sf)), 10)
    return round_columns(hits, "score").select("query_id", "product_id", "score", "rank")


@query(f"""WITH {S.similar(10)} SELECT query_id, product_id, {S.r('score', 6)} AS score, modalities,
  CAST(rk AS INTEGER) AS rank FROM sim""")
def similar_by_product(spark, sf):
    hits = _similar(spark, sf, 10).withColumn("modalities", F.array_join("matched_modalities", ","))
    return round_columns(hits, "score").select("query_id", "product_id", "score", "modalities", "rank")


@query(f"""WITH {S.related(10)} SELECT query_id, product_id, {S.r('score', 6)} AS score FROM sim""")
def related_by_product(spark, sf):
    hits = similar_products(None, self_neighbors(T.text_vectors(spark, sf), 10), 10)
    return round_columns(hits, "score").select("query_id", "product_id", "score")


PAYLOAD_TEXT = "concat_ws('. ', {0}.name, {0}.brand, {0}.category)"
RERANKED = f"""{S.similar(50)}, scored AS (SELECT s.*, {_logit(PAYLOAD_TEXT.format('t'), PAYLOAD_TEXT.format('c'))} AS logit
  FROM sim s JOIN catalog t ON t.product_id = s.query_id JOIN catalog c ON c.product_id = s.product_id),
rr AS (SELECT *, {SIGMOID} AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(logit, 9) DESC, rk) AS fk FROM scored)"""
MOVED = """CASE WHEN fk < rk THEN 'Moved up from position ' || rk || ' to ' || fk WHEN fk > rk
  THEN 'Moved down from position ' || rk || ' to ' || fk ELSE 'Kept at position ' || fk END || ' after cross-encoder reranking.'"""


def _reranked(spark, sf, k=None):
    catalog = T.indexed(spark, sf)
    return rerank(_similar(spark, sf, 50), J.query_texts(catalog), J.product_texts(catalog), k=k)


@query(f"""WITH {RERANKED} SELECT query_id, product_id, {S.r('rerank_score', 6)} AS rerank_score,
  CAST(rk AS INTEGER) AS original_rank, CAST(fk AS INTEGER) AS final_rank, CAST(rk - fk AS INTEGER) AS rank_delta,
  {MOVED} AS explanation FROM rr WHERE fk <= 10""")
def rerank_topk(spark, sf):
    return round_columns(_reranked(spark, sf, 10), "rerank_score").select(
        "query_id", "product_id", "rerank_score", "original_rank", "final_rank", "rank_delta",
        "explanation")


@query(f"""WITH {RERANKED} SELECT query_id, product_id, {S.r('rerank_score', 6)} AS rerank_score,
  CAST(rk AS INTEGER) AS original_rank, CAST(fk AS INTEGER) AS final_rank FROM rr WHERE fk <= 10""")
def rerank_model(spark, sf):
    """Reranking by a model that is loaded once a worker and scores batches of pairs."""
    catalog = T.indexed(spark, sf)
    hits = rerank(_similar(spark, sf, 50), J.query_texts(catalog), J.product_texts(catalog), k=10,
                  scorer=model_scorer(word_overlap_model))
    return round_columns(hits, "rerank_score").select(
        "query_id", "product_id", "rerank_score", "original_rank", "final_rank")


@query(f"""WITH {S.similar(10)} SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY price, s.product_id) AS INTEGER) AS by_price, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY price DESC, s.product_id) AS INTEGER) AS by_price_desc, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY name, s.product_id) AS INTEGER) AS by_name FROM (SELECT sim.*, name, price FROM sim JOIN catalog USING (product_id)) s""")
def sorted_results(spark, sf):
    from pyspark.sql import Window

    hits = hydrate(_similar(spark, sf, 10), T.indexed(spark, sf), ["name", "price"])

    def place(key, descending=False):
        return F.row_number().over(Window.partitionBy("query_id").orderBy(*L.result_order(key, descending)))

    return hits.select("query_id", "product_id", place("price").alias("by_price"),
                       place("price", True).alias("by_price_desc"), place("name").alias("by_name"))


# ---------------------------------------------------------------- recommendation


def _rec_sql(sim: str) -> str:
    attrs = ("color", "material", "season", "style")
    matched = ("list_filter([" + ", ".join(
        f"CASE WHEN lower(t.{a}) = lower(c.{a}) THEN '{a}' END" for a in attrs) + "], lambda x: x IS NOT NULL)")
    considered = " + ".join(f"(t.{a} IS NOT NULL AND c.{a} IS NOT NULL)::INT" for a in attrs)
    return f"""{sim}, rs0 AS (SELECT s.query_id, s.product_id, {S.clamp('s.score')} AS similarity_score,
  {matched} AS matched, {considered} AS considered, list_sort(list_intersect(list_distinct(t.tags), list_distinct(c.tags))) AS shared,
  len(list_distinct(list_concat(t.tags, c.tags))) AS n_tags, lower(t.brand) = lower(c.brand) AS shared_brand,
  lower(t.category) = lower(c.category) AS shared_category, c.quality_score, c.brand
  FROM sim s JOIN catalog t ON t.product_id = s.query_id JOIN catalog c ON c.product_id = s.product_id),
rs AS (SELECT *, coalesce(len(matched) / nullif(considered, 0)::DOUBLE, 0) AS attribute_score, len(shared) / n_tags::DOUBLE AS tag_score FROM rs0),
rf AS (SELECT *, {S.clamp('0.55::DOUBLE * similarity_score + 0.2::DOUBLE * attribute_score + 0.15::DOUBLE * tag_score + 0.1::DOUBLE * quality_score')}
  AS final_score FROM rs),
place AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, product_id) AS pl FROM rf),
rounds AS (SELECT *, row_number() OVER (PARTITION BY query_id, brand ORDER BY pl) AS rd,
  min(pl) OVER (PARTITION BY query_id, brand) AS fi FROM place),
recs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rd, fi) AS rank FROM rounds QUALIFY rank <= 10)"""


REC_COLUMNS = f"""query_id, product_id, {S.r('final_score', 6)} AS final_score, {S.r('similarity_score', 6)} AS similarity_score,
  {S.r('attribute_score', 6)} AS attribute_score, {S.r('tag_score', 6)} AS tag_score, array_to_string(matched, ',') AS matched,
  array_to_string(shared, ',') AS shared, shared_brand, shared_category, CAST(rank AS INTEGER) AS rank"""


def _recs(spark, sf):
    return J.recommend(*_both(spark, sf, 30), T.indexed(spark, sf))


def _rec_columns(recs):
    out = round_columns(recs, "final_score", "similarity_score", "attribute_score", "tag_score")
    return out.select(
        "query_id", "product_id", "final_score", "similarity_score", "attribute_score", "tag_score",
        F.array_join("matched_attributes", ",").alias("matched"),
        F.array_join("shared_tags", ",").alias("shared"), "shared_brand", "shared_category", "rank")


@query(f"WITH {_rec_sql(S.similar(30))} SELECT {REC_COLUMNS} FROM recs")
def recommend(spark, sf):
    return _rec_columns(_recs(spark, sf))


@query(f"""WITH {_rec_sql(f"{S.CATALOG}, {S.vectors('vt', 33, 64)}, {_lsh_sql('nt', 'vt', 31, 32)}, sim AS (SELECT query_id, product_id, score FROM nt"
  " WHERE query_id <> product_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) <= 30)")} SELECT {REC_COLUMNS} FROM recs""")
def recommend_lsh(spark, sf):
    """Recommendations from approximate neighbors."""
    near = self_neighbors(T.text_vectors(spark, sf), 30, neighbors=partial(knn_lsh, **LSH))
    return _rec_columns(J.recommend(None, near, T.indexed(spark, sf)))


@query(f"""WITH {_rec_sql(S.similar(30))} SELECT query_id, product_id, CAST(rank AS INTEGER) AS rank,
  CASE WHEN query_id % 3 = 2 THEN 'computed' ELSE 'stored' END AS origin FROM recs""")
def recommend_stored(spark, sf):
    """Stored recommendations while they are fresh, new ones for the products whose own have expired."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    recs = _recs(spark, sf)
    age = F.make_dt_interval(mins=(F.col("for_product_id") % 3 * 30).cast("int"))
    cache = materialize(J.cached_recommendations(recs, now - age).select(
        "for_product_id", "product_id", "rank", "computed_at"), "recommendations")
    wanted = T.indexed(spark, sf).select(F.col("product_id").alias("for_product_id"))
    expired = W.to_recompute(wanted, cache, now, key="for_product_id").withColumnRenamed("for_product_id", "query_id")
    fresh = W.fresh_entries(cache, now).select(
        F.col("for_product_id").alias("query_id"), "product_id", "rank", F.lit("stored").alias("origin"))
    return fresh.unionByName(recs.join(expired, "query_id", "left_semi").select(
        "query_id", "product_id", "rank", F.lit("computed").alias("origin")))


# An upsert: every twentieth product is altered (before it, its two vectors were the other way round), the next is put
# in, the one after taken out.
CHANGE = "CASE product_id % 20 WHEN 0 THEN 'altered' WHEN 1 THEN 'put in' WHEN 2 THEN 'taken out' END"


def _before(vectors, others):
    """Vectors before the change."""
    change = F.expr(CHANGE)
    rows = vectors.join(others.select("product_id", F.col("vector").alias("other")), "product_id")
    return rows.where(change.isNull() | (change != "put in")).select(
        "product_id", F.when(change == "altered", F.col("other")).otherwise(F.col("vector")).alias("vector"))


def _after(rows):
    return rows.where(~F.coalesce(F.expr(CHANGE) == "taken out", F.lit(False)))


def _changed(spark, sf):
    return T.indexed(spark, sf).where(F.expr(CHANGE).isNotNull()).select("product_id")


def _after_sql(text):
    return text.replace("FROM embeddings JOIN part ON p_partkey = vec_id)",
                        "FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 20 <> 2)")


@query(f"""WITH {S.vectors('vi', 1, 32)}, {S.vectors('vt', 33, 64)},
  vo AS (SELECT vi.product_id, CASE WHEN vi.product_id % 20 = 0 THEN vt.v ELSE vi.v END AS v, CASE WHEN vi.product_id % 20 = 0
    THEN vt.norm ELSE vi.norm END AS norm FROM vi JOIN vt USING (product_id) WHERE product_id % 20 <> 1),
  vn AS (SELECT * FROM vi WHERE product_id % 20 <> 2), {S.neighbors('o', 'vo', 11)}, {S.neighbors('n', 'vn', 11)},
  redo AS (SELECT DISTINCT query_id FROM o WHERE product_id % 20 < 3 UNION SELECT product_id FROM vn WHERE product_id % 20 < 3),
  came AS (SELECT DISTINCT query_id FROM n WHERE product_id % 20 < 3)
  SELECT query_id, product_id, {S.r('score', 6)} AS score, CAST(rk AS INTEGER) AS rank, CASE WHEN query_id IN (SELECT query_id FROM redo)
  THEN 'redone' WHEN query_id IN (SELECT query_id FROM came) THEN 'merged' ELSE 'kept' END AS how FROM n""")
def neighbors_after_upsert(spark, sf):
    """Neighbor lists kept up to date, and which of them were kept, merged or redone."""
    image, text = T.image_vectors(spark, sf), T.text_vectors(spark, sf)
    stored = materialize(self_neighbors(_before(image, text), 10), "lists")
    out = refresh_neighbors(stored, _after(image).select("product_id", "vector"), _changed(spark, sf), 11)
    return round_columns(out, "score")


@query(f"WITH {_rec_sql(_after_sql(S.similar(30)))} SELECT {REC_COLUMNS} FROM recs")
def recommend_after_upsert(spark, sf):
    """Recommendations kept up to date after an upsert and a delete, equal to recommending everything anew."""
    image, text = T.image_vectors(spark, sf), T.text_vectors(spark, sf)
    catalog = T.indexed(spark, sf)
    change = F.expr(CHANGE)
    lists = [materialize(self_neighbors(v, 30), "lists") for v in (_before(image, text), _before(text, image))]
    old = catalog.where(change.isNull() | (change != "put in")).withColumn(
        "brand", F.when(change == "altered", F.lit("Old brand")).otherwise(F.col("brand")))
    stored = materialize(J.recommend(*lists, old), "recommendations")
    recs, _ = refresh_recommendations(stored, *lists, _after(image), _after(text), _after(catalog), _changed(spark, sf), 30)
    return _rec_columns(recs)


@query(f"WITH {_rec_sql(S.related(30))} SELECT {REC_COLUMNS} FROM recs")
def recommend_related(spark, sf):
    return _rec_columns(J.recommend(None, self_neighbors(T.text_vectors(spark, sf), 30),
                                    T.indexed(spark, sf)))


@query(f"""WITH {_rec_sql(RERANKED.replace('sim AS (', 'sim50 AS (').replace('FROM sim s', 'FROM sim50 s')
  + ', sim AS (SELECT query_id, product_id, rerank_score AS score FROM rr)')} SELECT {REC_COLUMNS} FROM recs""")
def recommend_reranked(spark, sf):
    return _rec_columns(J.recommend(*_both(spark, sf, 50), T.indexed(spark, sf), reranked=True))


@query(f"""WITH {_rec_sql(S.similar(10))} SELECT query_id, product_id, brand, CAST(rd AS BIGINT) AS round,
  CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, brand ORDER BY rank) AS rd2 FROM recs)""")
def brand_round_robin(spark, sf):
    from pyspark.sql import Window

    scored = R.score_candidates(_similar(spark, sf, 10), T.indexed(spark, sf))
    rounds = Window.partitionBy("query_id", "brand").orderBy("rank")
    return R.brand_round_robin(scored, 10).select(
        "query_id", "product_id", "brand", F.row_number().over(rounds).cast("long").alias("round"), "rank")


REASON = """concat_ws('; ', CASE WHEN similarity_score >= 0.7 THEN 'similar visual appearance' END,
  CASE WHEN shared_category THEN 'same category' END, CASE WHEN shared_brand THEN 'same brand' END,
  CASE WHEN len(matched) > 0 THEN 'shared attributes (' || array_to_string(matched, ', ') || ')' END,
  CASE WHEN len(shared) > 0 THEN 'matching tags (' || array_to_string(shared[1:3], ', ') || ')' END,
  CASE WHEN quality_score >= 0.7 THEN 'high catalog quality' END)"""


@query(f"""WITH {_rec_sql(S.similar(30))}, e AS (SELECT query_id, product_id, {REASON} AS s FROM recs) SELECT query_id, product_id,
  CASE WHEN s = '' THEN 'Related based on overall similarity.' ELSE upper(left(s, 1)) || substr(s, 2) || '.' END AS explanation FROM e""")
def recommend_explanations(spark, sf):
    return _recs(spark, sf).select("query_id", "product_id", "explanation")


@query(f"""WITH {_rec_sql(S.similar(30))} SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY len(matched) DESC, product_id) AS INTEGER) AS by_attributes, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY len(shared) DESC, product_id) AS INTEGER) AS by_tags FROM recs WHERE shared_category AND len(matched) > 0 AND final_score >= 0.3""")
def recommend_filters(spark, sf):
    from pyspark.sql import Window

    kept = L.recommendation_view(_recs(spark, sf), shared_category=True, has_attributes=True, min_score=0.3)

    def place(key):
        return F.row_number().over(Window.partitionBy("query_id").orderBy(*L.recommendation_order(key)))

    return kept.select("query_id", "product_id", place("attributes").alias("by_attributes"),
                       place("tags").alias("by_tags"))


@query(f"""WITH {_rec_sql(S.similar(30))} SELECT query_id, count(*) FILTER (shared_brand) AS shared_brand,
  count(*) FILTER (shared_category) AS shared_category, count(*) FILTER (len(matched) > 0) AS with_attributes
  FROM recs GROUP BY 1""")
def recommend_overlap(spark, sf):
    return R.overlap_summary(_recs(spark, sf))


# ---------------------------------------------------------------- duplicates

NAME_VALUES = f"SELECT {S.tokens('p_name')} AS t FROM part"
FUZZY_VALUES = (f"SELECT {S.tokens('p_name')} AS t FROM part UNION ALL SELECT {S.tokens('p_type')} FROM part")


def _short_fuzzy(column: str) -> str:
    """Similarity over the distinct values of one catalog column."""
    return S.fuzzy_table(f"fz_{column}", f"SELECT DISTINCT {S.tokens(column)} AS t FROM catalog")


def _sim_of(field: str) -> tuple[str, str]:
    join = (f"LEFT JOIN fz_{field} z_{field} ON z_{field}.a = {S.tokens('t.' + field)} "
            f"AND z_{field}.b = {S.tokens('c.' + field)}")
    return f"z_{field}.sim", join


FUZZY_COLUMNS = ("name", "brand", "category", "color", "material", "style")
DUP_SCORED = f"""{S.similar(10)}, {', '.join(_short_fuzzy(c) for c in FUZZY_COLUMNS)},
sg AS (SELECT s.query_id, s.product_id, {S.clamp('s.image_score')} AS image_signal, {S.clamp('s.text_score')} AS text_signal,
  list_avg(list_filter([z_name.sim, z_brand.sim, z_category.sim], lambda x: x IS NOT NULL)) AS metadata_signal,
  list_avg(list_filter([z_brand.sim, z_category.sim, z_color.sim, z_material.sim, z_style.sim], lambda x: x IS NOT NULL)) AS attribute_signal,
  z_name.sim AS sim_name, z_category.sim AS sim_category
  FROM sim s JOIN catalog t ON t.product_id = s.query_id JOIN catalog c ON c.product_id = s.product_id
  {' '.join(_sim_of(c)[1] for c in FUZZY_COLUMNS)}),
dup AS (SELECT *, {S.clamp('0.35::DOUBLE * image_signal + 0.25::DOUBLE * text_signal + 0.2::DOUBLE * metadata_signal + 0.2::DOUBLE * attribute_signal')}
  AS overall FROM sg),
best AS (SELECT * FROM dup QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(overall, 9) DESC, product_id) = 1),
decisions AS (SELECT c.product_id AS query_id, coalesce(round(overall, 9) >= {DUPLICATE.threshold}, false) AS is_duplicate,
  coalesce(overall, 0) AS confidence, CASE WHEN round(overall, 9) >= {DUPLICATE.threshold} THEN b.product_id END AS matched_product,
  CASE WHEN b.product_id IS NULL THEN 'No candidates were found to compare against.' WHEN round(overall, 9) >= {DUPLICATE.threshold}
  THEN 'Overall similarity ' || {S.fixed('overall', 2)} || ' meets or exceeds the {DUPLICATE.threshold:.2f} threshold.'
  ELSE 'Best candidate similarity ' || {S.fixed('overall', 2)} || ' is below the {DUPLICATE.threshold:.2f} threshold.' END AS reason
  FROM catalog c LEFT JOIN best b ON b.query_id = c.product_id)"""


@query(f"""WITH {S.fuzzy_table('fz', NAME_VALUES)}, p AS (SELECT p_partkey, p_name, {S.tokens('p_name')} AS t FROM part)
  SELECT l.p_partkey AS left_id, r.p_partkey AS right_id, {S.r('sim', 6)} AS similarity FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
  JOIN p l ON l.p_partkey = a.l_partkey JOIN p r ON r.p_partkey = b.l_partkey JOIN fz ON fz.a = l.t AND fz.b = r.t""")
def fuzzy_pairs(spark, sf):
    """Names of parts on consecutive lines of an order."""
    lines = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    names = T.table(spark, sf, "part").select(
        F.col("p_partkey"), sorted_tokens(F.col("p_name")).alias("t"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"),
                         F.col("l_partkey").alias("right_id"))
    pairs = lines.withColumnRenamed("l_partkey", "left_id").join(after, ["l_orderkey", "l_linenumber"])
    left = names.select(F.col("p_partkey").alias("left_id"), F.col("t").alias("a"))
    right = names.select(F.col("p_partkey").alias("right_id"), F.col("t").alias("b"))
    return pairs.join(left, "left_id").join(right, "right_id").select(
        "left_id", "right_id",
        N.rounded(token_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""WITH {S.fuzzy_table('fz', NAME_VALUES)}, n AS (SELECT {S.tokens('p_name')} AS t, count(*) AS n FROM part GROUP BY 1)
  SELECT a, b, {S.r('sim', 6)} AS similarity, l.n AS left_products, r.n AS right_products FROM fz
  JOIN n l ON l.t = a JOIN n r ON r.t = b WHERE a < b AND sim >= 0.7""")
def fuzzy_matches(spark, sf):
    """All pairs of different product names that are alike, with the products that have them."""
    names = T.table(spark, sf, "part").select(sorted_tokens(F.col("p_name")).alias("value"))
    counts = names.groupBy("value").agg(F.count("*").alias("n"))
    return similar_values(names, 0.7).join(
        counts.selectExpr("value as a", "n as left_products"), "a").join(
        counts.selectExpr("value as b", "n as right_products"), "b").withColumn(
        "similarity", N.rounded(F.col("similarity"), 6))


def titles(spark, sf):
    """Name, brand and category of every product as one text of sorted tokens."""
    return T.catalog(spark, sf).select(sorted_tokens(F.concat_ws(" ", "name", "brand", "category")).alias("value"))


@query()
def fuzzy_title_matches(spark, sf):
    """All pairs of different product titles with a ratio of 0.85 or more: too many pairs for SQL without the bounds."""
    return round_columns(similar_values(titles(spark, sf), 0.85), "similarity")


PAIRS = DuplicateConfig(threshold=0.52)
PAIRS_SQL = f"""{S.CATALOG}, {S.vectors('vi', 1, 32)}, {S.vectors('vt', 33, 64)}, {', '.join(_short_fuzzy(c) for c in FUZZY_COLUMNS)},
ap AS (SELECT i.product_id AS query_id, j.product_id, list_inner_product(i.v, j.v) / (i.norm * j.norm) AS image_score,
  list_inner_product(t.v, u.v) / (t.norm * u.norm) AS text_score FROM vi i JOIN vi j ON i.product_id < j.product_id
  JOIN vt t ON t.product_id = i.product_id JOIN vt u ON u.product_id = j.product_id),
sg AS (SELECT s.query_id, s.product_id, {S.clamp('s.image_score')} AS image_signal, {S.clamp('s.text_score')} AS text_signal,
  list_avg(list_filter([z_name.sim, z_brand.sim, z_category.sim], lambda x: x IS NOT NULL)) AS metadata_signal,
  list_avg(list_filter([z_brand.sim, z_category.sim, z_color.sim, z_material.sim, z_style.sim], lambda x: x IS NOT NULL)) AS attribute_signal
  FROM ap s JOIN catalog t ON t.product_id = s.query_id JOIN catalog c ON c.product_id = s.product_id
  {' '.join(_sim_of(c)[1] for c in FUZZY_COLUMNS)}),
dup AS (SELECT *, {S.clamp('0.35::DOUBLE * image_signal + 0.25::DOUBLE * text_signal + 0.2::DOUBLE * metadata_signal + 0.2::DOUBLE * attribute_signal')}
  AS overall FROM sg)"""


@query(f"""WITH {PAIRS_SQL} SELECT query_id, product_id, {S.r('image_signal', 6)} AS image_signal, {S.r('text_signal', 6)} AS text_signal,
  {S.r('metadata_signal', 6)} AS metadata_signal, {S.r('attribute_signal', 6)} AS attribute_signal,
  {S.r('overall', 6)} AS overall_similarity FROM dup WHERE round(overall, 9) >= {PAIRS.threshold}""")
def duplicate_pairs_blocked(spark, sf):
    """All pairs of products at or above the threshold, by bounds that lose none."""
    pairs = duplicate_pairs(T.image_vectors(spark, sf), T.text_vectors(spark, sf), T.indexed(spark, sf), PAIRS)
    return round_columns(pairs, "image_signal", "text_signal", "metadata_signal", "attribute_signal", "overall_similarity")


@query(f"""WITH {DUP_SCORED} SELECT query_id, product_id, {S.r('image_signal', 6)} AS image_signal, {S.r('text_signal', 6)} AS text_signal,
  {S.r('metadata_signal', 6)} AS metadata_signal, {S.r('attribute_signal', 6)} AS attribute_signal,
  {S.r('overall', 6)} AS overall_similarity FROM dup""")
def duplicate_signals(spark, sf):
    catalog = T.indexed(spark, sf)
    return round_columns(D.score_pairs(_similar(spark, sf, 10), catalog, catalog), "image_signal",
                         "text_signal", "metadata_signal", "attribute_signal", "overall_similarity")


def _decisions(spark, sf):
    return J.detect_duplicates(_similar(spark, sf, 10), T.catalog(spark, sf), T.indexed(spark, sf), cfg=CFG)


@query(f"""WITH {DUP_SCORED} SELECT query_id, is_duplicate, {S.r('confidence', 6)} AS confidence, matched_product, reason FROM decisions""")
def duplicate_decisions(spark, sf):
    return round_columns(_decisions(spark, sf), "confidence").drop("top_candidates")


@query(f"""WITH {DUP_SCORED} SELECT product_id, name FROM catalog WHERE product_id NOT IN (
  SELECT query_id FROM decisions WHERE is_duplicate)""")
def duplicate_gate(spark, sf):
    return D.gate(T.catalog(spark, sf), _decisions(spark, sf), "block").select("product_id", "name")


def _rules_sql(pairs: str, category_fz: str = "fz_category", name_fz: str = "fz_name") -> str:
    """rules(query_id, product_id, codes, messages, rule_score, veto) of ``pairs``."""
    gap = "abs(t.price - c.price) / greatest(abs(c.price), 1e-9)"
    overlap = ("list_filter([CASE WHEN lower(t.color) = lower(c.color) THEN 'color' END, CASE WHEN lower(t.material) = lower(c.material) "
               "THEN 'material' END, CASE WHEN lower(t.style) = lower(c.style) THEN 'style' END], lambda x: x IS NOT NULL)")
    return f"""rule0 AS (SELECT s.*, lower(t.brand) = lower(c.brand) AS ok_b, zc.sim >= 0.9 AS ok_c, {gap} <= 0.25 AS ok_p,
  zn.sim >= 0.85 AS ok_n, len({overlap}) > 0 AS ok_o,
  CASE WHEN lower(t.brand) = lower(c.brand) THEN 'Same brand (' || t.brand || ')' ELSE 'Different brand (' || t.brand || ' vs ' || c.brand || ')' END AS mb,
  CASE WHEN zc.sim >= 0.9 THEN 'Same category (' || t.category || ')' ELSE 'Different category (' || t.category || ' vs ' || c.category || ')' END AS mc,
  CASE WHEN {gap} <= 0.25 THEN 'Similar price (within ' || {S.percent(gap)} || ')' ELSE 'Price differs by ' || {S.percent(gap)} END AS mp,
  CASE WHEN zn.sim >= 0.85 THEN 'Title similarity ' || {S.percent('zn.sim')} ELSE 'Title similarity only ' || {S.percent('zn.sim')} END AS mn,
  CASE WHEN len({overlap}) > 0 THEN 'Matching attributes: ' || array_to_string({overlap}, ', ') ELSE 'No matching attributes' END AS mo
  FROM {pairs} s JOIN catalog t ON t.product_id = s.query_id JOIN catalog c ON c.product_id = s.product_id
  LEFT JOIN {category_fz} zc ON zc.a = {S.tokens('t.category')} AND zc.b = {S.tokens('c.category')}
  LEFT JOIN {name_fz} zn ON zn.a = {S.tokens('t.name')} AND zn.b = {S.tokens('c.name')}),
rules AS (SELECT *, (ok_b::INT + ok_c::INT + ok_p::INT + ok_n::INT + ok_o::INT) / 5.0::DOUBLE AS rule_score, NOT ok_b AS veto,
  concat_ws(' | ', mb, mc, mp, mn, mo) AS messages FROM rule0)"""


RULE_FUZZY = f"{_short_fuzzy('name')}, {_short_fuzzy('category')}"


@query(f"""WITH {S.similar(10)}, {RULE_FUZZY}, {_rules_sql('sim')} SELECT query_id, product_id,
  {S.r('rule_score', 6)} AS rule_score, veto, messages FROM rules""")
def business_rules(spark, sf):
    catalog = T.indexed(spark, sf)
    ruled = D.apply_rules(_similar(spark, sf, 10).select("query_id", "product_id"), catalog, catalog, VERIFY)
    return ruled.select("query_id", "product_id", N.rounded(F.col("rule_score"), 6).alias("rule_score"), "veto",
                        F.array_join(F.transform("rules", lambda r: r["message"]), " | ").alias("messages"))


VERIFY_SQL = f"""{S.similar(10)}, {RULE_FUZZY}, rr0 AS (SELECT s.*, {_logit(PAYLOAD_TEXT.format('t'), PAYLOAD_TEXT.format('c'))} AS logit
  FROM sim s JOIN catalog t ON t.product_id = s.query_id JOIN catalog c ON c.product_id = s.product_id),
top1 AS (SELECT *, {SIGMOID} AS ce FROM rr0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(logit, 9) DESC, rk) = 1),
{_rules_sql('top1')},
verdicts AS (SELECT k.product_id AS query_id, coalesce(round(ce, 9) >= 0.7 AND NOT veto, false) AS is_duplicate,
  coalesce(0.7::DOUBLE * ce + 0.3::DOUBLE * rule_score, 0) AS confidence, ce AS cross_encoder_score, r.score AS retrieval_similarity,
  r.product_id AS matched_product, CASE WHEN r.product_id IS NULL THEN ['No existing products were found to compare against.'] ELSE
  ['Cross-encoder relevance ' || {S.fixed('ce', 2)} || CASE WHEN round(ce, 9) >= 0.7 THEN ' meets' ELSE ' is below' END || ' the 0.70 threshold.',
   mb, mc, mp, mn, mo] END AS reasons FROM catalog k LEFT JOIN rules r ON r.query_id = k.product_id)"""


def _verdicts(spark, sf):
    catalog = T.catalog(spark, sf)
    return J.verify_duplicates(_similar(spark, sf, 10), catalog, catalog, cfg=CFG)


@query(f"""WITH {VERIFY_SQL} SELECT query_id, is_duplicate, {S.r('confidence', 6)} AS confidence,
  {S.r('cross_encoder_score', 6)} AS cross_encoder_score, {S.r('retrieval_similarity', 6)} AS retrieval_similarity,
  matched_product, array_to_string(reasons, ' | ') AS reasons FROM verdicts""")
def duplicate_verification(spark, sf):
    out = round_columns(_verdicts(spark, sf), "confidence", "cross_encoder_score", "retrieval_similarity")
    return out.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: r["message"]), " | "))


@query(f"""WITH {DUP_SCORED} SELECT query_id, is_duplicate, {S.r('confidence', 6)} AS confidence, matched_product,
  'weighted_similarity: ' || reason AS reasons FROM decisions""")
def weighted_verification(spark, sf):
    out = round_columns(D.as_verification(_decisions(spark, sf)), "confidence")
    text = F.transform("reasons", lambda r: F.concat(r["code"], F.lit(": "), r["message"]))
    return out.select("query_id", "is_duplicate", "confidence", "matched_product",
                      F.array_join(text, "; ").alias("reasons"))


@query(f"""WITH {S.similar(10)}, pr AS (SELECT s.query_id, s.product_id, t, c FROM sim s JOIN catalog t ON t.product_id = s.query_id
  JOIN catalog c ON c.product_id = s.product_id), long AS (
  {' UNION ALL '.join(f"SELECT query_id, product_id, '{f}' AS field, t.{f} AS l, c.{f} AS r FROM pr" for f in ('brand', 'category', 'color', 'style'))}
  UNION ALL SELECT query_id, product_id, 'gender', NULL, NULL FROM pr)
  SELECT query_id, product_id, field, CASE WHEN coalesce(l, '') = '' OR coalesce(r, '') = '' THEN 'incomparable'
  WHEN lower(trim(l)) = lower(trim(r)) THEN 'same' ELSE 'different' END AS verdict FROM long""")
def compare_pairs(spark, sf):
    catalog = T.indexed(spark, sf)
    return compare_fields(_similar(spark, sf, 10), catalog, catalog,
                          ["brand", "category", "color", "style", "gender"]).drop("left_value", "right_value")


# ---------------------------------------------------------------- pricing

COMPS = f"""{S.similar(50)}, comps AS (SELECT s.query_id AS subject_id, s.product_id, c.price, s.score AS similarity, c.category,
  CASE WHEN lower(c.category) <> lower(t.category) THEN 'category' WHEN s.score < 0.15 THEN 'similarity' ELSE 'kept' END AS outcome,
  lower(t.category) AS subject_category FROM sim s JOIN catalog t ON t.product_id = s.query_id
  JOIN catalog c ON c.product_id = s.product_id WHERE c.price > 0)"""


def _judged(spark, sf):
    catalog = T.indexed(spark, sf)
    subjects = catalog.select(F.col("product_id").alias("subject_id"), "category")
    return P.judge(P.comparables(_similar(spark, sf, 50), catalog), subjects, PRICING), subjects


@query(f"""WITH {COMPS} SELECT subject_id, product_id, price, {S.r('similarity', 6)} AS similarity, outcome FROM comps""")
def price_comparables(spark, sf):
    return round_columns(_judged(spark, sf)[0], "similarity").select(
        "subject_id", "product_id", "price", "similarity", "outcome")


@query(f"""WITH {COMPS} SELECT subject_id, count(*) FILTER (outcome = 'category') AS excluded_by_category,
  count(*) FILTER (outcome = 'similarity') AS excluded_by_similarity, count(*) FILTER (outcome = 'kept') AS kept
  FROM comps GROUP BY 1""")
def price_filter_counts(spark, sf):
    return P.outcome_counts(_judged(spark, sf)[0])


def _quartile(i):
    j = f"greatest(1, least((({i}) * (n + 1)) // 4, n - 1))"
    d = f"({i} * (n + 1) - 4 * {j})"
    return f"(ps[{j}] * (4 - {d}) + ps[{j} + 1] * {d}) / 4.0::DOUBLE"


USED = f"""{COMPS}, kept AS (SELECT * FROM comps WHERE outcome = 'kept'),
arr AS (SELECT subject_id, list_sort(list(price)) AS ps, count(*) AS n FROM kept GROUP BY 1),
fence AS (SELECT subject_id, n, {_quartile(1)} AS q1, {_quartile(3)} AS q3 FROM arr),
used AS (SELECT k.* FROM kept k JOIN fence f USING (subject_id) WHERE n < 4 OR
  (price >= q1 - 1.5::DOUBLE * (q3 - q1) AND price <= q3 + 1.5::DOUBLE * (q3 - q1))),
place AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY price, product_id) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM used),
agg AS (SELECT subject_id, count(*) AS n, median(price) AS med, coalesce(sum(price * greatest(similarity, 0)) / nullif(sum(greatest(similarity, 0)), 0),
  avg(price)) AS wavg, avg(price) FILTER (rn > floor(n * 0.1::DOUBLE) AND rn <= n - floor(n * 0.1::DOUBLE)) AS trimmed,
  {S.r('least(count(*) / 6.0::DOUBLE, 1) * greatest(0, 1 - CASE WHEN count(*) > 1 THEN stddev_pop(price) / avg(price) ELSE 0 END)', 3)} AS conf FROM place GROUP BY 1),
ex AS (SELECT subject_id, count(*) FILTER (outcome = 'category') AS xc, count(*) FILTER (outcome = 'similarity') AS xs,
  count(*) FILTER (outcome = 'kept') AS nk FROM comps GROUP BY 1),
est AS (SELECT t.product_id AS subject_id, coalesce(n, 0) AS n, med, wavg, trimmed, coalesce(conf, 0) AS conf, coalesce(xc, 0) AS xc, coalesce(xs, 0) AS xs,
  coalesce(nk, 0) - coalesce(n, 0) AS removed, lower(t.category) AS cat,
  CASE WHEN coalesce(n, 0) < 3 THEN 'low' WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.4 THEN 'medium' ELSE 'low' END AS band
  FROM (SELECT * FROM catalog JOIN embeddings ON vec_id = product_id) t LEFT JOIN agg ON agg.subject_id = t.product_id LEFT JOIN ex ON ex.subject_id = t.product_id),
txt AS (SELECT *, CASE WHEN xc + xs = 0 THEN '' ELSE 'after excluding ' || concat_ws(' and ', CASE WHEN xc > 0 THEN xc || ' from other categories (not ' || cat || ')' END,
  CASE WHEN xs > 0 THEN xs || ' below the 0.15 similarity floor' END) END AS xt FROM est)"""


@query(f"""WITH {USED} SELECT subject_id, count(*) AS kept, sum((product_id IN (SELECT product_id FROM used u
  WHERE u.subject_id = kept.subject_id))::INT)::BIGINT AS used FROM kept GROUP BY 1""")
def price_outliers(spark, sf):
    judged, subjects = _judged(spark, sf)
    out = P.estimate(judged, subjects, PRICING)
    n = F.col("comparable_count").cast("long")
    return out.filter(n > 0).select("subject_id", (n + F.col("outliers_removed")).alias("kept"), n.alias("used"))


def _priced(strategy):
    def run(spark, sf):
        judged, subjects = _judged(spark, sf)
        return P.estimate(judged, subjects, PRICING, strategy).select(
            "subject_id", "estimated_price", "status", "confidence", "confidence_score",
            F.col("comparable_count").cast("long").alias("comparable_count"), "reason")

    return run


def _price_sql(strategy, column):
    return f"""WITH {USED} SELECT subject_id, {S.r(column, 2)} AS estimated_price, CASE WHEN n > 0 THEN 'estimated' ELSE 'no_estimate' END AS status,
  band AS confidence, conf AS confidence_score, n AS comparable_count, CASE WHEN n > 0 THEN concat_ws(' ', 'Estimated from ' || n ||
  ' comparable product(s) using the {strategy} strategy', nullif(xt, ''), CASE WHEN removed > 0 THEN 'after removing ' || removed || ' price outlier(s)' END,
  '(' || band || ' confidence)') || '.' WHEN xt = '' THEN 'No comparable priced products were found.' ELSE 'No relevant comparable products remained ' || xt ||
  '. No price is estimated; a value drawn from unrelated products would be misleading.' END AS reason FROM txt"""


for _name, _strategy, _column in (("price_median", "median", "med"),
                                  ("price_weighted", "weighted_average", "wavg"),
                                  ("price_trimmed", "trimmed_mean", "trimmed")):
    query(_price_sql(_strategy, _column), _name)(_priced(_strategy))


@query(f"""WITH {S.similar(20)}, comps AS (SELECT s.query_id, CASE WHEN lower(c.category) <> lower(t.category) THEN 'category'
  WHEN s.score < 0.5 THEN 'similarity' ELSE 'kept' END AS outcome FROM sim s JOIN catalog t ON t.product_id = s.query_id
  JOIN catalog c ON c.product_id = s.product_id)
  SELECT query_id AS subject_id, count(*) FILTER (outcome = 'kept') > 0 AS has_price, count(*) FILTER (outcome = 'category') AS excluded_by_category,
  count(*) FILTER (outcome = 'similarity') AS excluded_by_similarity FROM comps GROUP BY 1""")
def price_estimates(spark, sf):
    """The pricing job with its default limits."""
    catalog = T.indexed(spark, sf)
    subjects = catalog.select(F.col("product_id").alias("subject_id"), "category")
    return J.price(_similar(spark, sf, 20), subjects, catalog).select(
        "subject_id", F.col("estimated_price").isNotNull().alias("has_price"), "excluded_by_category",
        "excluded_by_similarity")


@query(f"""WITH {USED}, sp AS (SELECT subject_id, count(*) AS n, min(price) AS lo, median(price) AS md, max(price) AS hi,
  {S.r('avg(price) FILTER (rn > floor(n * 0.1::DOUBLE) AND rn <= n - floor(n * 0.1::DOUBLE))', 2)} AS e FROM place GROUP BY 1)
  SELECT subject_id, CAST(n AS INTEGER) AS n, lo AS min_price, {S.r('md', 4)} AS median_price, hi AS max_price,
  {S.r('CASE WHEN hi > lo THEN ' + S.clamp('(e - lo) / (hi - lo)') + ' END', 6)} AS estimate_position FROM sp""")
def price_spread(spark, sf):
    judged, subjects = _judged(spark, sf)
    out = P.price_spread(P.estimate(judged, subjects, PRICING))
    return round_columns(round_columns(out, "median_price", digits=4), "estimate_position")


@query(f"""WITH {USED} SELECT subject_id, product_id, price, CAST(rn - 1 AS INTEGER) AS position FROM place""")
def price_cheapest_first(spark, sf):
    judged, subjects = _judged(spark, sf)
    return P.cheapest_first(P.estimate(judged, subjects, PRICING)).drop("similarity")


# ---------------------------------------------------------------- evaluation

EVAL = f"""{S.similar(10)}, {S.vectors('vf', 1, 64)}, {S.neighbors('nf', 'vf', 6)},
expected AS (SELECT query_id, product_id FROM nf WHERE query_id <> product_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) <= 5)"""


def _metric_sql(name: str, ranked: str) -> str:
    """Per-query metrics of ``ranked`` (query_id, product_id, rk) against ``expected``."""
    parts = []
    for k in (1, 5, 10):
        parts += [
            f"count(*) FILTER (rel AND rk <= {k}) / count(*) FILTER (rk <= {k})::DOUBLE AS precision_at_{k}",
            f"count(*) FILTER (rel AND rk <= {k}) / 5.0::DOUBLE AS recall_at_{k}",
            f"coalesce(sum(1 / log2(rk + 1)) FILTER (rel AND rk <= {k}), 0) / "
            f"(SELECT sum(1 / log2(x + 1)) FROM range(1, {min(5, k) + 1}) t(x)) AS ndcg_at_{k}",
            f"(count(*) FILTER (rel AND rk <= {k}) > 0)::INT::DOUBLE AS hit_rate_at_{k}",
        ]
    return f"""{name} AS (SELECT query_id, {', '.join(parts)}, coalesce(1.0::DOUBLE / min(rk) FILTER (rel), 0) AS reciprocal_rank
  FROM (SELECT s.query_id, rk, e.product_id IS NOT NULL AS rel FROM {ranked} s LEFT JOIN expected e
  ON e.query_id = s.query_id AND e.product_id = s.product_id) GROUP BY 1)"""


METRICS = [*V.metric_names(), "reciprocal_rank"]


def _expected(spark, sf):
    vectors = T.full_vectors(spark, sf)
    return knn_join(self_queries(vectors), vectors, 5, exclude_self=True).select("query_id", "product_id")


def _per_query(spark, sf, ranked):
    """Queries are split over the three tasks by label; label 9 stands for a failed query."""
    expected = _expected(spark, sf)
    label = F.col("label")
    task = F.when(label % 3 == 0, "retrieval").when(label % 3 == 1, "recommendation").otherwise("duplicate")
    queries = T.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), task.alias("task_type"),
        F.when(label == 9, "failed").alias("error"), (label / F.lit(10.0)).alias("latency_seconds")
    ).join(V.expected_counts(expected), "query_id")
    return V.query_metrics(queries, V.flag_relevance(ranked, expected))


@query(f"""WITH {EVAL}, {_metric_sql('m', 'sim')} SELECT query_id, {', '.join(S.r(c, 6) + ' AS ' + c for c in METRICS)} FROM m""")
def retrieval_metrics(spark, sf):
    ranked = _similar(spark, sf, 10).select("query_id", "product_id", "rank")
    return round_columns(_per_query(spark, sf, ranked).select("query_id", *METRICS), *METRICS)


TASKS_SQL = """(SELECT vec_id AS query_id, CASE label % 3 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'recommendation' ELSE 'duplicate' END AS task_type,
  label = 9 AS failed, label / 10.0::DOUBLE AS lat FROM embeddings)"""


def _summary_sql(name: str, source: str) -> str:
    means = ", ".join(f"avg({m}) FILTER (NOT failed) AS {m}" for m in V.metric_names())
    return f"""{name} AS (SELECT task_type, {means}, avg(reciprocal_rank) FILTER (NOT failed) AS mrr,
  avg(lat) FILTER (NOT failed) AS average_latency_seconds, count(*) FILTER (NOT failed) AS query_count,
  count(*) FILTER (failed) AS failure_count FROM {source} JOIN {TASKS_SQL} USING (query_id) GROUP BY 1)"""


SUMMARY = [*V.metric_names(), "mrr", "average_latency_seconds"]


@query(f"""WITH {EVAL}, {_metric_sql('m', 'sim')}, {_summary_sql('s', 'm')} SELECT task_type,
  {', '.join(S.r(c, 6) + ' AS ' + c for c in SUMMARY)}, query_count, failure_count FROM s""")
def metrics_by_task(spark, sf):
    ranked = _similar(spark, sf, 10).select("query_id", "product_id", "rank")
    return round_columns(V.task_metrics(_per_query(spark, sf, ranked)), *SUMMARY)


RERANK_EVAL = f"""{RERANKED}, {S.vectors('vf', 1, 64)}, {S.neighbors('nf', 'vf', 6)},
expected AS (SELECT query_id, product_id FROM nf WHERE query_id <> product_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) <= 5),
before_r AS (SELECT query_id, product_id, rk FROM sim WHERE rk <= 10),
after_r AS (SELECT query_id, product_id, fk AS rk FROM rr WHERE fk <= 10),
{_metric_sql('mb', 'before_r')}, {_metric_sql('ma', 'after_r')}, {_summary_sql('sb', 'mb')}, {_summary_sql('sa', 'ma')}"""


def _reports(spark, sf):
    hits = _similar(spark, sf, 50)
    catalog = T.indexed(spark, sf)
    after = rerank(hits, J.query_texts(catalog), J.product_texts(catalog), k=10).select(
        "query_id", "product_id", F.col("final_rank").alias("rank"))
    before = hits.filter("rank <= 10").select("query_id", "product_id", "rank")
    return V.task_metrics(_per_query(spark, sf, before)), V.task_metrics(_per_query(spark, sf, after))


@query(f"""WITH {RERANK_EVAL} {' UNION ALL '.join(
    f"SELECT sb.task_type, '{m}' AS metric, {S.r('sb.' + m, 6)} AS before, {S.r('sa.' + m, 6)} AS after, {S.r(f'sa.{m} - sb.{m}', 6)} AS delta "
    "FROM sb JOIN sa USING (task_type)" for m in SUMMARY)}""")
def rerank_diff(spark, sf):
    before, after = _reports(spark, sf)
    return round_columns(J.compare_reports(before, after), "before", "after", "delta")


def _md_line(label: str, m: str) -> str:
    delta = S.r(f"sa.{m} - sb.{m}", 4)
    return (f"'| {label} | ' || {S.fixed('sb.' + m, 4)} || ' | ' || {S.fixed('sa.' + m, 4)} || ' | ' || "
            f"format('{{:+.4f}}', {delta}) || ' |'")


_ROWS = [_md_line("MRR", "mrr")] + [_md_line(f"{V.LABELS[m]}@{k}", f"{m}_at_{k}") for m in V.AT_K for k in (1, 5, 10)]
_ROWS.append(_md_line("Avg latency (s)", "average_latency_seconds"))


@query(f"""WITH {RERANK_EVAL} SELECT task_type, array_to_string(['## ' || upper(left(task_type, 1)) || substr(task_type, 2), '',
  '| Metric | Before | After | Delta |', '|---|---|---|---|', {', '.join(_ROWS)}, ''], chr(10)) AS markdown
  FROM sb JOIN sa USING (task_type)""")
def comparison_markdown(spark, sf):
    return V.comparison_markdown(J.compare_reports(*_reports(spark, sf)))


def _report_rows():
    for k in (1, 5, 10):
        cells = " || ' | ' || ".join(S.fixed(f"{m}_at_{k}", 4) for m in V.AT_K)
        yield f"'| {k} | ' || {cells} || ' |'"


@query(f"""WITH {EVAL}, {_metric_sql('m', 'sim')}, {_summary_sql('s', 'm')} SELECT task_type, array_to_string([
  '## ' || upper(left(task_type, 1)) || substr(task_type, 2), '', '- Queries evaluated: ' || query_count, '- MRR: ' || {S.fixed('mrr', 4)},
  '- Average latency: ' || {S.fixed('average_latency_seconds', 4)} || 's', '', '| K | Precision@K | Recall@K | NDCG@K | Hit Rate@K |',
  '|---|---|---|---|---|', {', '.join(_report_rows())}, ''], chr(10)) AS markdown FROM s""")
def report_markdown(spark, sf):
    ranked = _similar(spark, sf, 10).select("query_id", "product_id", "rank")
    return V.report_markdown(V.task_metrics(_per_query(spark, sf, ranked)))


def _dataset(spark, sf):
    """Every benchmark item as an entry of a JSON dataset: its task by turns, and now and then a malformed one."""
    item = F.col("item_id")
    task = F.when(item % 3 == 0, "retrieval").when(item % 3 == 1, "recommendation").otherwise("duplicate")
    expected = _expected(spark, sf).groupBy(F.col("query_id").alias("pid")).agg(
        F.sort_array(F.collect_list(F.col("product_id").cast("string"))).alias("expected"))  # five each
    rows = T.table(spark, sf, "benchmark").withColumn("pid", F.when(item % 3 == 0, item).otherwise(item * 14)).join(
        expected, "pid", "left")
    entry = F.struct(
        F.concat(F.lit("item-"), item.cast("string")).alias("query_id"), task.alias("task_type"), "text",
        F.when(item % 3 != 0, F.col("pid").cast("string")).alias("product_id"), F.col("expected").alias("expected_products"),
        F.when(item % 10 == 9, F.lit(0)).alias("top_k"))
    return parse_dataset(rows.select(F.to_json(F.array(entry)).alias("value"), "item_id"), "item_id").withColumn(
        "position", F.col("item_id"))


def _routes(spark, sf):
    """Ranked lists by task, the routes sharing two neighbor tables."""
    image, text = _both(spark, sf, 30)
    catalog = T.indexed(spark, sf)

    def item(entries):
        return entries.select("query_id", F.substring_index("query_id", "-", -1).cast("long").alias("item"))

    def retrieval(entries):
        vectors = T.text_vectors(spark, sf)
        asked = item(entries).join(vectors.select(F.col("product_id").alias("item"), "vector"), "item").select(
            "query_id", F.lit(None).cast("array<float>").alias("image_vector"), F.col("vector").alias("text_vector"))
        return search(asked, T.image_vectors(spark, sf), vectors, 10)

    def of_product(entries, lists):
        wanted = entries.select(F.col("query_id").alias("entry"), F.col("product_id").cast("long").alias("query_id"))
        return lists.join(wanted, "query_id").select(F.col("entry").alias("query_id"), "product_id", "rank")

    def recommendation(entries):
        return of_product(entries, J.recommend(image, text, catalog))

    def duplicate(entries):
        from vitrine.operators.neighbors import top_k

        scored = D.score_pairs(similar_products(image, text, 10), catalog, catalog, DUPLICATE)
        return of_product(entries, top_k(scored.withColumn("by", N.rank_value(F.col("overall_similarity"))), 10, by="by"))

    return {"retrieval": retrieval, "recommendation": recommendation, "duplicate": duplicate}


def _dataset_sql(where: str = "true") -> str:
    """s: the report over the benchmark items that ``where`` leaves."""
    return f"""rec AS (WITH {_rec_sql(S.similar(30))} SELECT query_id, product_id, rank AS rk FROM recs),
dd AS (WITH {DUP_SCORED} SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY round(overall, 9) DESC, product_id) AS rk FROM dup),
ret AS (WITH {S.vectors('vt', 33, 64)}, {S.neighbors('nt', 'vt', 10)} SELECT query_id, product_id, rk FROM nt),
truth AS (WITH {S.vectors('vf', 1, 64)}, {S.neighbors('nf', 'vf', 6)} SELECT query_id, product_id FROM nf WHERE query_id <> product_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) <= 5),
items AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'recommendation' ELSE 'duplicate' END AS task_type,
  CASE WHEN item_id % 3 = 0 THEN item_id ELSE item_id * 14 END AS pid FROM benchmark WHERE {where}),
ranked AS (SELECT item_id AS query_id, product_id, rk FROM items JOIN rec ON pid = query_id WHERE item_id % 3 = 1
  UNION ALL SELECT item_id, product_id, rk FROM items JOIN dd ON pid = query_id WHERE item_id % 3 = 2
  UNION ALL SELECT item_id, product_id, rk FROM items JOIN ret ON pid = query_id WHERE item_id % 3 = 0),
expected AS (SELECT item_id AS query_id, product_id FROM items JOIN truth ON pid = query_id), {_metric_sql('m', 'ranked')},
state AS (SELECT item_id AS query_id, task_type, item_id % 10 = 9 OR (item_id % 3 <> 0 AND pid NOT IN (SELECT product_id FROM catalog JOIN
  embeddings ON vec_id = product_id)) AS failed FROM items),
s AS (SELECT task_type, {', '.join(f"coalesce(avg(coalesce({m}, 0)) FILTER (NOT failed), 0) AS {m}" for m in V.metric_names())},
  coalesce(avg(coalesce(reciprocal_rank, 0)) FILTER (NOT failed), 0) AS mrr, 0.0::DOUBLE AS average_latency_seconds,
  count(*) FILTER (NOT failed) AS query_count, count(*) FILTER (failed) AS failure_count FROM state LEFT JOIN m USING (query_id) GROUP BY 1)"""


NAMED = [f"item-{i}" for i in (2, 3, 4, 7, 9, 19, 30, 31, 37)]


def _by_task(spark, sf, **which):
    return evaluate_by_task(_dataset(spark, sf), T.indexed(spark, sf), _routes(spark, sf), **which)


@query(f"""WITH {S.CATALOG}, {_dataset_sql()} SELECT task_type, {', '.join(S.r(c, 6) + ' AS ' + c for c in SUMMARY)}, query_count, failure_count FROM s""")
def evaluate_dataset(spark, sf):
    """Every entry by its task's route; malformed entries and those of unknown products fail alone."""
    return round_columns(_by_task(spark, sf), *SUMMARY)


@query(f"""WITH {S.CATALOG}, {_dataset_sql("item_id IN (SELECT item_id FROM benchmark WHERE item_id IN (2, 3, 4, 7, 9, 19, 30, 31, 37) ORDER BY item_id LIMIT 7)")}
  SELECT task_type, {', '.join(S.r(c, 6) + ' AS ' + c for c in SUMMARY)}, query_count, failure_count FROM s""")
def evaluate_named_entries(spark, sf):
    """The named entries, then the first seven of them."""
    return round_columns(_by_task(spark, sf, ids=NAMED, limit=7), *SUMMARY)


@query(f"""WITH {S.CATALOG}, {_dataset_sql()} SELECT array_to_string(['# Benchmark Report', '', '- Generated at: 2024-01-30', '- Dataset size: ' ||
  sum(query_count + failure_count)::BIGINT, '- Total duration: 8.0000s', '- Failures: ' || sum(failure_count)::BIGINT, '- Throughput: ' ||
  {S.fixed('sum(query_count + failure_count) / 8.0', 2)} || ' queries/second', ''], chr(10)) AS markdown FROM s""")
def evaluation_header(spark, sf):
    return V.report_header(_by_task(spark, sf), 8.0, "2024-01-30")


# ---------------------------------------------------------------- explanations


def _flat(traces, *keys):
    return traces.select(
        *keys, "decision_type", "subject_id", "summary",
        F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"),
        F.array_join(F.transform("components", lambda c: c["name"]), ",").alias("components"),
        N.rounded(F.aggregate("components", F.lit(0.0), lambda s, c: s + c["contribution"]), 6)
        .alias("contributions"),
        N.rounded(F.col("confidence"), 6).alias("confidence"))


@query(f"""WITH {S.similar(10)} SELECT query_id, product_id, 'hybrid_search' AS decision_type, CAST(product_id AS VARCHAR) AS subject_id,
  'Ranked by hybrid similarity: ' || {S.percent('image_score')} || ' image similarity and ' || {S.percent('text_score')} || ' text similarity.' AS summary,
  'image_similarity,text_similarity' AS codes, 'image_similarity,text_similarity' AS components, {S.r('score', 6)} AS contributions,
  {S.r('score', 6)} AS confidence FROM sim""")
def explain_hybrid(spark, sf):
    return _flat(X.explain_hybrid(_similar(spark, sf, 10)), "query_id", "product_id")


@query(f"""WITH {RERANKED} SELECT query_id, product_id, 'reranking' AS decision_type, CAST(product_id AS VARCHAR) AS subject_id,
  'Reranked by cross-encoder: cross-encoder relevance ' || {S.percent('rerank_score')} || ' and ' || {MOVED} || '.' AS summary,
  'cross_encoder_score,rank_movement' AS codes, 'original_score,cross_encoder_score' AS components,
  {S.r('score + rerank_score', 6)} AS contributions, {S.r('rerank_score', 6)} AS confidence FROM rr WHERE fk <= 10""")
def explain_rerank(spark, sf):
    return _flat(X.explain_rerank(_reranked(spark, sf, 10)), "query_id", "product_id")


def _oxford(items: str) -> str:
    return (f"CASE len({items}) WHEN 1 THEN {items}[1] WHEN 2 THEN {items}[1] || ' and ' || {items}[2] ELSE "
            f"array_to_string({items}[1:len({items}) - 1], ', ') || ', and ' || {items}[-1] END")


@query(f"""WITH {VERIFY_SQL} SELECT query_id, 'duplicate' AS decision_type, CAST(matched_product AS VARCHAR) AS subject_id,
  CASE WHEN is_duplicate THEN 'Judged a duplicate because: ' ELSE 'Not a duplicate because: ' END || {_oxford('reasons')} || '.' AS summary,
  CASE WHEN matched_product IS NULL THEN '' ELSE 'cross_encoder_score,retrieval_similarity' END AS components,
  {S.r('confidence', 6)} AS confidence FROM verdicts""")
def explain_duplicate(spark, sf):
    return _flat(X.explain_duplicate(_verdicts(spark, sf)), "query_id").drop("codes", "contributions")


EXPLAIN_REC = f"""{_rec_sql(S.similar(30))}, why AS (SELECT *, list_filter([CASE WHEN shared_brand THEN 'the same brand' END,
  CASE WHEN shared_category THEN 'the same category' END, CASE WHEN len(matched) > 0 THEN 'matching ' || array_to_string(matched, ', ') END,
  CASE WHEN len(shared) > 0 THEN 'shared tags (' || array_to_string(shared, ', ') || ')' END], lambda x: x IS NOT NULL) AS why FROM recs)"""
REC_SUMMARY = f"CASE WHEN len(why) = 0 THEN 'Recommended because it shares.' ELSE 'Recommended because it shares: ' || {_oxford('why')} || '.' END"


@query(f"""WITH {EXPLAIN_REC} SELECT query_id, product_id, 'recommendation' AS decision_type, CAST(product_id AS VARCHAR) AS subject_id,
  {REC_SUMMARY} AS summary, array_to_string(list_filter([CASE WHEN shared_brand THEN 'shared_brand' END, CASE WHEN shared_category THEN 'shared_category' END,
  CASE WHEN len(matched) > 0 THEN 'matched_attributes' END, CASE WHEN len(shared) > 0 THEN 'shared_tags' END], lambda x: x IS NOT NULL), ',') AS codes,
  'similarity,attribute_match,tag_match,quality' AS components, {S.r('final_score', 6)} AS contributions, {S.r('final_score', 6)} AS confidence FROM why""")
def explain_recommendation(spark, sf):
    return _flat(X.explain_recommendation(_recs(spark, sf)), "query_id", "product_id")


@query(f"""WITH {DUP_SCORED}, x AS (SELECT query_id, 'duplicate' AS decision_type, CAST(matched_product AS VARCHAR) AS subject_id,
  CASE WHEN is_duplicate THEN 'Judged a duplicate because: ' ELSE 'Not a duplicate because: ' END || reason || '.' AS summary FROM decisions
  WHERE query_id IN (SELECT vec_id FROM embeddings))
  SELECT * FROM x UNION ALL SELECT * FROM (WITH {EXPLAIN_REC} SELECT query_id, 'recommendation', CAST(product_id AS VARCHAR), {REC_SUMMARY} FROM why)""")
def explain_products(spark, sf):
    image, text = _both(spark, sf, 30)
    catalog = T.indexed(spark, sf)
    decisions = J.detect_duplicates(similar_products(image, text, 10), catalog, catalog, cfg=CFG)
    traces = J.explain_products(decisions, J.recommend(image, text, catalog))
    return traces.select("query_id", "decision_type", "subject_id", "summary")


# ---------------------------------------------------------------- ingest behind the duplicate gate

GATE = DuplicateConfig(threshold=0.46)


def _submissions(spark, sf):
    """Products with both vectors, and the delivery each comes with; null for those that are stored already."""
    size = T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), "p_size")
    image = T.image_vectors(spark, sf).select("product_id", F.col("vector").alias("image_vector"))
    text = T.text_vectors(spark, sf).select("product_id", F.col("vector").alias("text_vector"))
    rows = T.indexed(spark, sf).select("product_id", *D.FUZZY_FIELDS).join(image, "product_id").join(
        text, "product_id").join(size, "product_id")
    return rows.withColumn("delivery", F.when(F.col("p_size") % 3 == 0, F.col("product_id") % 4)).drop("p_size")


GATE_SQL = f"""{PAIRS_SQL}, link AS MATERIALIZED (SELECT query_id AS a, product_id AS b, overall FROM dup WHERE round(overall, 9) >= {GATE.threshold}),
pair2 AS (SELECT a, b, overall FROM link UNION ALL SELECT b, a, overall FROM link),
item AS MATERIALIZED (SELECT c.product_id, row_number() OVER (ORDER BY c.product_id % 4, c.product_id) AS i FROM catalog c
  JOIN embeddings ON vec_id = c.product_id WHERE c.p_size % 3 = 0)"""


def _verdict_sql(accepted: str) -> str:
    """Verdicts of the delivered products; a partner counts if it is stored or earlier and ``accepted``."""
    return f"""part_of AS (SELECT x.product_id, b.b AS other, overall FROM item x JOIN pair2 b ON b.a = x.product_id
  LEFT JOIN item y ON y.product_id = b.b WHERE y.i IS NULL OR (y.i < x.i AND {accepted})),
best AS (SELECT * FROM part_of QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(overall, 9) DESC, other) = 1)
SELECT x.product_id, b.other IS NOT NULL AS is_duplicate, b.other AS matched_product, {S.r('coalesce(b.overall, 0)', 6)} AS confidence"""


@query(f"""WITH RECURSIVE {GATE_SQL},
near AS MATERIALIZED (SELECT x.i, coalesce(list(y.i) FILTER (y.i < x.i), []) AS js, coalesce(bool_or(b.b IS NOT NULL AND y.i IS NULL), false) AS hit
  FROM item x LEFT JOIN pair2 b ON b.a = x.product_id LEFT JOIN item y ON y.product_id = b.b GROUP BY x.i),
walk(i, acc) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.i, CASE WHEN hit OR list_has_any(acc, js) THEN acc ELSE list_append(acc, n.i) END
  FROM walk JOIN near n ON n.i = walk.i + 1),
let_in AS MATERIALIZED (SELECT unnest(acc) AS i FROM (SELECT acc FROM walk ORDER BY i DESC LIMIT 1)),
{_verdict_sql('y.i IN (SELECT i FROM let_in)')}, x.i IN (SELECT i FROM let_in) AS accepted
  FROM item x LEFT JOIN best b USING (product_id)""")
def stream_gated_ingest(spark, sf):
    """Four deliveries, one after the other, through the gate: against the catalog, earlier deliveries and their own."""
    rows = materialize(_submissions(spark, sf), "submissions")
    stored = rows.where("delivery is null").drop("delivery")
    base = working_dir(spark, "gate")
    for delivery in range(4):
        new = rows.where(F.col("delivery") == delivery).drop("delivery").withColumn("place", F.col("product_id"))
        new.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(new.schema).parquet(f"{base}/in")
        G.start_gate(stream, stored, f"{base}/out", f"{base}/checkpoint", cfg=GATE).awaitTermination()
    return round_columns(G.decisions(spark, f"{base}/out"), "confidence").drop("batch_id")


@query(f"""WITH {GATE_SQL}, {_verdict_sql('true')}, CASE WHEN b.other IS NULL THEN 'new' ELSE 'duplicate' END AS outcome
  FROM item x LEFT JOIN best b USING (product_id)""")
def duplicate_new_products(spark, sf):
    """Products that are not indexed yet, held against the catalog and those submitted before them."""
    rows = materialize(_submissions(spark, sf), "submissions")
    new = rows.where("delivery is not null").withColumn("place", F.struct("delivery", "product_id")).drop("delivery")
    found = G.judge_batch(new, rows.where("delivery is null").drop("delivery"), "warn", GATE)
    return round_columns(found, "confidence").select(
        "product_id", "is_duplicate", "matched_product", "confidence",
        F.when(F.col("is_duplicate"), "duplicate").otherwise("new").alias("outcome"))


@query(f"""WITH {GATE_SQL}, v AS (WITH {_verdict_sql('true')} FROM item x LEFT JOIN best b USING (product_id)),
  modes AS (SELECT unnest(['off', 'warn', 'block']) AS mode),
  sub AS (SELECT p_partkey AS product_id, p_name AS name, p_retailprice AS price, length(concat_ws(' ', ({S.sql_list(T.PHRASES)})[p_size % {len(T.PHRASES)} + 1],
    text)) AS n FROM part LEFT JOIN documents ON doc_id = p_partkey)
  SELECT mode, product_id, 'stored' AS state FROM catalog JOIN embeddings ON vec_id = product_id, modes WHERE p_size % 3 <> 0
  UNION ALL SELECT mode, product_id, CASE WHEN NOT (price >= 0 AND n <= 2000) THEN 'rejected' WHEN mode = 'block' AND is_duplicate THEN 'turned away'
    ELSE 'ingested' END FROM v JOIN sub USING (product_id), modes
  UNION ALL SELECT mode, c.product_id, 'stale recommendation' FROM catalog c JOIN embeddings ON vec_id = c.product_id, modes
    WHERE p_size % 3 <> 0 AND c.product_id % 7 = 0 AND EXISTS (SELECT 1 FROM v JOIN sub USING (product_id) WHERE v.product_id = c.product_id + 1
      AND price >= 0 AND n <= 2000 AND NOT (mode = 'block' AND is_duplicate))""")
def ingest_gated(spark, sf):
    """Submitted products through checks, enrichment with image predictions, the duplicate gate in each of its modes
    and the upsert; cached recommendations of what came in are given up."""
    rows = materialize(_submissions(spark, sf), "submissions")
    delivered = rows.where("delivery is not null").select("product_id")
    new = rows.where("delivery is not null").withColumn("place", F.struct("delivery", "product_id")).drop("delivery")
    known = rows.where("delivery is null")
    verdicts = materialize(G.judge_batch(new, known.drop("delivery"), "warn", GATE).withColumnRenamed(
        "product_id", "query_id"), "verdicts")
    raw = T.submitted(spark, sf).join(delivered, "product_id", "left_semi").withColumn("version", F.lit(1))
    raw = materialize(raw, "raw")
    stats = I.image_statistics(T.pixels(spark, sf), T.image_sizes(spark, sf), T.PIXEL_SIDE).join(
        delivered.withColumnRenamed("product_id", "image_id"), "image_id", "left_semi")
    stats = materialize(stats, "images")
    catalog = T.indexed(spark, sf).join(known.select("product_id"), "product_id", "left_semi").withColumn("version", F.lit(0))
    cache = known.where("product_id % 7 = 0").select(
        F.col("product_id").alias("for_product_id"), (F.col("product_id") + 1).alias("product_id"))
    out = None
    for mode in G.MODES:
        after, rejected = J.ingest(raw, catalog, verdicts, mode=mode, image_predictions=I.image_predictions(stats),
                                   image_tags=I.image_tags(stats))
        after = materialize(after.select("product_id", "version"), "ingested")
        came = after.where("version = 1").select("product_id")
        fresh = W.invalidate(cache, came)
        lost = cache.join(fresh.select("for_product_id"), "for_product_id", "left_anti")
        turned = delivered.join(came, "product_id", "left_anti").join(rejected.select("product_id"), "product_id", "left_anti")
        parts = {"stored": after.where("version = 0"), "ingested": came, "turned away": turned,
                 "rejected": rejected, "stale recommendation": lost.select(F.col("for_product_id").alias("product_id"))}
        for state, part in parts.items():
            part = part.select(F.lit(mode).alias("mode"), "product_id", F.lit(state).alias("state"))
            out = part if out is None else out.unionByName(part)
    return out
