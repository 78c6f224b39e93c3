"""Normalization, intake, lookup, table maintenance and text queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from registry import frames as T
from registry import sql as S
from registry.core import query
from vitrine.config import DEFAULTS
from vitrine.functions import scalars as N
from vitrine.operators import enrich as E
from vitrine.operators import filters as L
from vitrine.operators import images as I
from vitrine.operators import lookup as K
from vitrine.operators.embed import IMAGE_BATCH, fit_text_weights, hashed_text_vectors, model_embedder
from vitrine.operators.models import letter_model, quarter_model
from vitrine.operators.neighbors import knn_join
from vitrine.plans import catalog_jobs as J
from vitrine.session import working_dir
from vitrine.sources import catalog as C
from vitrine.sources import sinks as W
from vitrine.sources.evaluation import parse_dataset

STRIP = r"'^\s+|\s+$'"


@query(f"""SELECT value, {S.facet('value')} AS facet_key FROM (
  SELECT url AS value FROM pages UNION ALL SELECT c_name FROM customer
  UNION ALL SELECT o_orderpriority FROM orders)""")
def facet_keys(spark, sf):
    values = (T.table(spark, sf, "pages").select(F.col("url").alias("value"))
              .unionAll(T.table(spark, sf, "customer").select("c_name"))
              .unionAll(T.table(spark, sf, "orders").select("o_orderpriority")))
    return values.withColumn("facet_key", N.facet_key(F.col("value")))


@query(f"""WITH {S.SUBMITTED} SELECT product_id, trim(name) AS name, nullif(trim(brand), '') AS brand,
  {S.facet('category')} AS category, length(regexp_replace(description, {STRIP}, '', 'g')) AS description_length,
  {S.r('price', 2)} AS price, {S.facet('brand')} AS brand_key FROM submitted""")
def normalize_products(spark, sf):
    return L.normalize_products(T.submitted(spark, sf)).select(
        "product_id", "name", "brand", "category",
        F.length("description").cast("long").alias("description_length"), "price", "brand_key")


@query("""SELECT doc_id AS product_id, CASE WHEN trim(lang || ' ' || source) = '' THEN 'name is blank'
  WHEN n_chars - 300 < 0 THEN 'price is negative'
  WHEN length(lang || ' ' || source) > 200 THEN 'name is too long' WHEN length(source) > 100 THEN 'brand is too long' WHEN length(text) > 2000 THEN 'description is too long'
  WHEN length(lang) > 100 THEN 'category is too long' END AS reject_reason
  FROM documents WHERE reject_reason IS NOT NULL""")
def rejected_products(spark, sf):
    raw = T.table(spark, sf, "documents").select(
        F.col("doc_id").alias("product_id"), F.concat_ws(" ", "lang", "source").alias("name"),
        F.col("source").alias("brand"), F.col("lang").alias("category"),
        F.col("text").alias("description"), (F.col("n_chars") - 300).alias("price"))
    return L.split_rejected(raw)[1].select("product_id", "reject_reason")


@query(f"""WITH {S.SUBMITTED}, t AS (SELECT product_id, concat_ws('. ', trim(name),
  nullif(trim(brand), ''), nullif(trim(category), ''),
  nullif(regexp_replace(description, {STRIP}, '', 'g'), '')) AS text FROM submitted)
  SELECT product_id, length(text) AS text_length, md5(text) AS text_md5 FROM t""")
def text_representation(spark, sf):
    text = N.text_representation(F.col("name"), F.col("brand"), F.col("category"), F.col("description"))
    return T.submitted(spark, sf).select(
        "product_id", F.length(text).cast("long").alias("text_length"), F.md5(text).alias("text_md5"))


@query(f"""WITH {S.CATALOG} SELECT product_id, concat_ws('. ', name, brand, category) AS text FROM catalog
  UNION ALL SELECT page_id, CAST(page_id AS VARCHAR) FROM pages""")
def payload_text(spark, sf):
    pages = T.table(spark, sf, "pages").select(
        F.col("page_id").alias("product_id"), *[F.lit("").alias(c) for c in (
            "name", "brand", "category", "description")])
    return J.product_texts(T.catalog(spark, sf).select(pages.columns).unionAll(pages))


@query(f"""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
  SELECT vec_id, CAST(i AS INTEGER) AS position, {S.r('v[i] / sqrt(list_inner_product(v, v))', 6)} AS value
  FROM u, generate_series(1, 64) g(i) WHERE i <= len(v)""")
def unit_vectors(spark, sf):
    unit = T.table(spark, sf, "embeddings").select("vec_id", N.l2_normalize(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("position", "value")).select(
        "vec_id", (F.col("position") + 1).alias("position"), N.rounded(F.col("value"), 6).alias("value"))


@query("""SELECT label, count(*) FILTER (len(v) = 64) AS usable, count(*) FILTER (len(v) <> 64) AS quarantined
  FROM (SELECT label, CASE WHEN label = 3 THEN embedding[1:63] ELSE embedding END AS v FROM embeddings)
  GROUP BY label""")
def vector_quality(spark, sf):
    vectors = T.table(spark, sf, "embeddings").select(
        "label", F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(
            F.col("embedding")).alias("vector"))
    good, bad = C.split_by_dimension(vectors, 64)
    rows = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return rows.groupBy("label").agg(F.count_if("ok").alias("usable"),
                                     F.count_if(~F.col("ok")).alias("quarantined"))


@query(f"""WITH {S.CATALOG} SELECT product_id, name, price FROM catalog
  WHERE brand_key = 'brand-7' AND price >= 950 AND price <= 1500""")
def facet_price_filter(spark, sf):
    return L.filter_products(T.catalog(spark, sf), brand=" Brand#7 ", category="  ",
                             min_price=950.0, max_price=1500.0).select("product_id", "name", "price")


@query("""SELECT page_id, f AS file_name, e AS extension, size_bytes, checksum, CASE WHEN e NOT IN ('.jpg', '.jpeg', '.png', '.webp') THEN 'extension'
  WHEN size_bytes > 2000 THEN 'too large' END AS reject_reason FROM (
  SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || x AS f, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1) || x, '.(\\.[^.]+)$', 1)) AS e,
  CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, sha256(html) AS checksum
  FROM (SELECT *, ['.JPG', '.png', '.gif', '.webp', ''][page_id % 5 + 1] AS x FROM pages))""")
def file_intake(spark, sf):
    """Pages as uploaded files of several kinds, accepted up to 2,000 bytes."""
    kind = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".gif", ".webp", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    files = T.table(spark, sf, "pages").select(
        "page_id", F.concat("url", kind).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return L.check_files(C.describe_files(files), replace(DEFAULTS.intake, max_bytes=2000)).select(
        "page_id", "file_name", "extension", "size_bytes", "checksum", "reject_reason")


@query("""SELECT sha256(text) AS checksum, count(*) AS copies, min(CAST(doc_id AS VARCHAR)) AS first_path
  FROM documents GROUP BY 1 HAVING count(*) > 1""")
def file_copies(spark, sf):
    files = T.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return C.exact_copies(C.describe_files(files))


@query("""SELECT user_id, left(sha256('user-' || user_id), 12) AS prefix,
  sha256('user-' || user_id) AS hash, 'cat_' || user_id || '_products' AS scoped_name
  FROM (SELECT DISTINCT user_id FROM events)""")
def key_hashes(spark, sf):
    key = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return T.table(spark, sf, "events").select("user_id").distinct().select(
        "user_id", N.key_prefix(N.key_hash(key)).alias("prefix"), N.key_hash(key).alias("hash"),
        N.tenant_scoped(F.lit("cat"), F.col("user_id"), F.lit("products")).alias("scoped_name"))


# ---------------------------------------------------------------- lookups


@query("""SELECT p_partkey AS product_id, p_partkey IN (SELECT vec_id FROM embeddings) AS indexed FROM part""")
def lookup_exists(spark, sf):
    vectors = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"))
    return K.flag_existing(T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id")), vectors)


@query("""SELECT l_orderkey AS request_id, l_partkey AS product_id, min(l_linenumber) AS position,
  bool_or(v.vec_id IS NOT NULL) AS found FROM lineitem LEFT JOIN embeddings v ON v.vec_id = l_partkey
  GROUP BY 1, 2""")
def lookup_batch(spark, sf):
    requests = T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("position"))
    vectors = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"))
    return K.batch_resolve(requests, vectors)


@query("""SELECT d.doc_id AS product_id, CASE WHEN v.vec_id IS NOT NULL THEN 'image'
  WHEN p.p_partkey IS NOT NULL THEN 'text' END AS found_in,
  CASE WHEN v.vec_id IS NOT NULL THEN 'vector-' || v.label WHEN p.p_partkey IS NOT NULL THEN p.p_name END AS name
  FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN part p ON p.p_partkey = d.doc_id""")
def lookup_fallback(spark, sf):
    image = T.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("product_id"), F.concat(F.lit("vector-"), "label").alias("name"))
    text = T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"),
                                             F.col("p_name").alias("name"))
    ids = T.table(spark, sf, "documents").select(F.col("doc_id").alias("product_id"))
    return K.retrieve_with_fallback(ids, image, text, ["name"], ("image", "text"))


@query("""SELECT coalesce(vec_id, p_partkey) AS product_id, vec_id IS NOT NULL AS in_image,
  p_partkey IS NOT NULL AS in_text FROM embeddings FULL JOIN part ON vec_id = p_partkey
  WHERE vec_id IS NULL OR p_partkey IS NULL""")
def collection_overlap(spark, sf):
    return K.coverage(
        T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id")),
        T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id")))


@query("""SELECT p_partkey AS product_id, regexp_replace(p_name, ' ', '_') || '.v1.jpg' AS image_filename
  FROM part JOIN embeddings ON vec_id = p_partkey""")
def image_reference(spark, sf):
    stored = T.indexed(spark, sf).select("product_id", F.concat(
        F.replace("name", F.lit(" "), F.lit("_")), F.lit(".v1.png")).alias("stored"))
    return stored.select("product_id", N.processed_filename(F.col("stored")).alias("image_filename"))


# ---------------------------------------------------------------- table maintenance


@query("""WITH u AS (SELECT o_custkey, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT coalesce(c_custkey, o_custkey) AS product_id, coalesce(o_totalprice, c_acctbal) AS price,
  o_orderkey AS order_id FROM customer FULL JOIN u ON c_custkey = o_custkey""")
def upsert_latest(spark, sf):
    table = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("product_id"), F.col("c_acctbal").alias("price"),
        F.lit(None).cast("bigint").alias("order_id"),
        F.lit(None).cast("struct<at:timestamp_ntz,id:bigint>").alias("version"))
    updates = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("product_id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("order_id"),
        F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id")).alias("version"))
    return W.upsert(table, updates).drop("version")


@query("""SELECT p_partkey AS product_id, p_name AS name FROM part
  WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1)""")
def delete_ids(spark, sf):
    gone = T.table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_discount = 0.1D").select(
        F.col("l_partkey").alias("product_id"))
    return W.delete(T.catalog(spark, sf).select("product_id", "name"), gone)


CACHE = """cache AS (SELECT user_id AS product_id, max(ts) AS computed_at FROM events GROUP BY 1),
now AS (SELECT max(ts) AS t FROM events)"""


def _cache(spark, sf):
    events = T.table(spark, sf, "events")
    rows = events.groupBy(F.col("user_id").alias("product_id")).agg(F.max("ts").alias("computed_at"))
    return rows, events.agg(F.max("ts")).scalar()


@query(f"""WITH {CACHE} SELECT product_id, computed_at::VARCHAR AS computed_at FROM cache, now
  WHERE epoch_us(t) - epoch_us(computed_at) < 3600::BIGINT * 1000000""")
def fresh_cache(spark, sf):
    rows, now = _cache(spark, sf)
    return W.fresh_entries(rows, now).withColumn("computed_at", F.col("computed_at").cast("string"))


@query(f"""WITH {CACHE} SELECT c_custkey AS product_id FROM customer WHERE c_custkey NOT IN (
  SELECT product_id FROM cache, now WHERE epoch_us(t) - epoch_us(computed_at) < 3600::BIGINT * 1000000)""")
def cache_to_recompute(spark, sf):
    rows, now = _cache(spark, sf)
    wanted = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("product_id"))
    return W.to_recompute(wanted, rows, now)


@query("""SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'query-0' ELSE 'q' || item_id END AS query_id,
  CASE item_id % 6 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'unknown task type' WHEN 2 THEN 'top_k must be positive'
  WHEN 3 THEN 'needs product_id' WHEN 4 THEN 'needs text or image_path' END AS problem
  FROM benchmark WHERE item_id % 6 <> 0 UNION ALL SELECT item_id, 'query-0', 'not a JSON object' FROM benchmark WHERE item_id % 6 = 0""")
def dataset_problems(spark, sf):
    """Each benchmark item as a dataset of one entry, most with a fault."""
    kind = F.col("item_id") % 6
    entry = F.to_json(F.struct(
        F.when(F.col("item_id") % 7 != 0, F.concat(F.lit("q"), F.col("item_id").cast("string"))).alias("query_id"),
        F.when(kind == 1, "other").when(kind == 3, "duplicate").otherwise("retrieval").alias("task_type"),
        F.when(kind != 4, F.col("text")).alias("text"), F.when(kind == 2, -1).otherwise(5).alias("top_k")))
    value = F.concat(F.lit("["), F.when(kind == 0, "7").otherwise(entry), F.lit("]"))
    files = T.table(spark, sf, "benchmark").select("item_id", value.alias("value"))
    return parse_dataset(files, "item_id").select("item_id", "query_id", "problem")


@query("""SELECT p_partkey AS query_id, CASE WHEN vec_id IS NOT NULL AND p_size % 2 = 0 THEN 'hybrid' WHEN vec_id IS NOT NULL THEN 'image'
  WHEN p_size % 2 = 0 THEN 'text' END AS mode, CASE WHEN vec_id IS NULL AND p_size % 2 <> 0 THEN 'image or text required' END AS reject_reason
  FROM part LEFT JOIN embeddings ON vec_id = p_partkey AND label <> 1""")
def query_presence(spark, sf):
    vectors = T.table(spark, sf, "embeddings").where("label <> 1").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("image_vector"))
    asked = T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  ").alias("text"))
    return L.check_query_presence(asked.join(vectors, "query_id", "left")).select("query_id", "mode", "reject_reason")


# ---------------------------------------------------------------- text and images


@query(f"""WITH {S.text_attributes()} SELECT product_id, attribute, value, confidence, 'text' AS source FROM attrs""")
def text_attributes(spark, sf):
    return E.text_attributes(T.submitted(spark, sf))


@query(f"""WITH {S.text_tags()} SELECT product_id, tag, confidence, 'text' AS source FROM tags""")
def text_tags(spark, sf):
    return E.text_tags(T.submitted(spark, sf)).drop("position")


CHANNEL = ("CAST(floor(greatest(0::DOUBLE, least(255::DOUBLE, (e[(i + {0}) % 64 + 1]::DOUBLE + 0.3::DOUBLE) "
           "* 425.0::DOUBLE)) / 32) AS INTEGER) * 32")
PIXELS = f"""
px AS (SELECT image_id, i, i % 8 AS x, i // 8 AS y, {CHANNEL.format(0)} AS r, {CHANNEL.format(21)} AS g,
  {CHANNEL.format(42)} AS b FROM (SELECT vec_id AS image_id, embedding AS e, unnest(range(0, 64)) AS i FROM embeddings)),
ring AS (SELECT image_id, list_sort(list(r)) AS lr, list_sort(list(g)) AS lg, list_sort(list(b)) AS lb
  FROM px WHERE x < 1 OR y < 1 OR x >= 7 OR y >= 7 GROUP BY 1),
bg AS (SELECT image_id, lr[len(lr) // 2 + 1] AS br, lg[len(lg) // 2 + 1] AS bgg, lb[len(lb) // 2 + 1] AS bb FROM ring),
far AS (SELECT px.*, (r-br)*(r-br) + (g-bgg)*(g-bgg) + (b-bb)*(b-bb) > 3600 AS is_far FROM px JOIN bg USING (image_id)),
cnt AS (SELECT image_id, count(*) FILTER (is_far) AS nf FROM far GROUP BY 1),
used AS (SELECT far.* FROM far JOIN cnt USING (image_id) WHERE nf < 64 * 0.02 OR is_far),
dom AS (SELECT image_id, r AS dr, g AS dg, b AS db FROM (SELECT image_id, r, g, b, count(*) AS n, min(i) AS f
  FROM used GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) = 1),
luma AS (SELECT image_id, avg(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255 AS brightness FROM used GROUP BY 1),
hls AS (SELECT *, (hi + lo) / 2 AS light, hi - lo AS span FROM (SELECT image_id, dr, dg, db, dr / 255.0::DOUBLE AS fr,
  dg / 255.0::DOUBLE AS fg, db / 255.0::DOUBLE AS fb, greatest(dr, dg, db) / 255.0::DOUBLE AS hi,
  least(dr, dg, db) / 255.0::DOUBLE AS lo FROM dom)),
hue AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN light <= 0.5 THEN span / (hi + lo) ELSE span / (2 - hi - lo) END AS sat,
  CASE WHEN span = 0 THEN 0 WHEN fr = hi THEN (fg - fb) / span WHEN fg = hi THEN 2 + (fb - fr) / span
  ELSE 4 + (fr - fg) / span END / 6 AS turn FROM hls),
named AS (SELECT *, (turn - floor(turn)) * 360 AS deg FROM hue),
near AS (SELECT image_id, arg_min(name, struct_pack(d := round(least(abs(deg - h), 360 - abs(deg - h)), 9), o := o)) AS nm
  FROM named, (VALUES {", ".join(f"({i}, '{n}', {h}::DOUBLE)" for i, (n, h) in enumerate(I.HUES))}) hues(o, name, h) GROUP BY 1),
stats AS (SELECT image_id, br * 65536 + bgg * 256 + bb AS background, CASE WHEN nf < 64 * 0.02 THEN 0 ELSE nf END AS subject_pixels,
  dr * 65536 + dg * 256 + db AS dominant, CASE WHEN light <= 0.2 THEN 'black' WHEN sat < 0.15 AND light >= 0.85 THEN 'white'
  WHEN sat < 0.15 THEN 'gray' ELSE nm END AS color_name, brightness,
  CASE WHEN brightness <= 0.35 THEN 'dark' WHEN brightness >= 0.6 THEN 'bright' ELSE 'medium' END AS brightness_bucket,
  CASE WHEN h > w THEN 'portrait' WHEN w > h THEN 'landscape' ELSE 'square' END AS orientation,
  CASE WHEN w * h <= 250000 THEN 'low_resolution' WHEN w * h <= 1000000 THEN 'medium_resolution' ELSE 'high_resolution' END AS resolution,
  w / h::DOUBLE AS aspect_ratio
  FROM named JOIN near USING (image_id) JOIN bg USING (image_id) JOIN cnt USING (image_id) JOIN luma USING (image_id)
  JOIN (SELECT p_partkey AS image_id, p_size * 40 AS w, p_size % 7 * 200 + 100 AS h FROM part) USING (image_id))"""


def _stats(spark, sf):
    return I.image_statistics(T.pixels(spark, sf), T.image_sizes(spark, sf), T.PIXEL_SIDE)


@query(f"""WITH {PIXELS} SELECT image_id, background, subject_pixels, dominant, color_name,
  {S.r('brightness', 6)} AS brightness, brightness_bucket, orientation, resolution,
  {S.r('aspect_ratio', 6)} AS aspect_ratio FROM stats""")
def image_statistics(spark, sf):
    def code(c):
        return F.col(f"{c}.r") * 65536 + F.col(f"{c}.g") * 256 + F.col(f"{c}.b")

    return _stats(spark, sf).select(
        "image_id", code("background").alias("background"),
        F.col("subject_pixels").cast("long").alias("subject_pixels"), code("dominant").alias("dominant"),
        "color_name", N.rounded(F.col("brightness"), 6).alias("brightness"), "brightness_bucket",
        "orientation", "resolution", N.rounded(F.col("aspect_ratio"), 6).alias("aspect_ratio"))


@query("""SELECT p_partkey AS image_id, CASE WHEN p_type NOT IN ('JPEG', 'PNG', 'WEBP') AND p_size % 3 <> 0 THEN 'format'
  WHEN p_size * 200 > 8000 THEN 'dimensions' END AS reject_reason FROM part""")
def image_checks(spark, sf):
    images = T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"),
        F.when(F.col("p_size") % 3 == 0, "jpeg").otherwise(F.col("p_type")).alias("format"),
        (F.col("p_size") * 200).alias("width"), F.lit(100).alias("height"))
    return L.check_images(images).select("image_id", "reject_reason")


@query(f"""WITH {PIXELS}, h AS (SELECT image_id, r // 32 * 64 + g // 32 * 8 + b // 32 AS cell, count(*) AS n FROM px GROUP BY ALL)
  SELECT image_id, CAST(cell AS INTEGER) AS cell, {S.r('n / sqrt(sum(n * n) OVER (PARTITION BY image_id))', 4)} AS share FROM h""")
def color_histogram(spark, sf):
    """All cells that are not zero."""
    v = I.color_histogram(T.pixels(spark, sf))
    return v.select("image_id", F.posexplode("vector").alias("cell", "share")).where("share > 0").select(
        "image_id", "cell", N.rounded(F.col("share"), 4).alias("share"))


PREDICTIONS = f"""{S.text_attributes()}, {PIXELS},
preds AS (SELECT product_id, attribute, value, confidence, 'text' AS source FROM attrs
  UNION ALL SELECT image_id, 'color', upper(left(color_name, 1)) || substr(color_name, 2), 0.7::DOUBLE, 'image' FROM stats),
merged AS (SELECT product_id, attribute, arg_max(value, struct_pack(c := confidence, t := (source = 'text')::INT)) AS value,
  max(confidence) AS confidence, count(DISTINCT value) > 1 AS conflict FROM preds GROUP BY 1, 2)"""


def _predictions(spark, sf):
    return E.text_attributes(T.submitted(spark, sf)).unionByName(I.image_predictions(_stats(spark, sf)))


@query(f"""WITH {PREDICTIONS} SELECT product_id, attribute, value, confidence, conflict,
  confidence >= 0.6 AS accepted FROM merged""")
def merged_attributes(spark, sf):
    return E.merge_attributes(_predictions(spark, sf)).drop("source")


@query(f"""WITH {PREDICTIONS}, w AS (SELECT product_id, count(*) AS filled, avg(confidence) AS confidence,
  count(*) FILTER (conflict) AS conflicts, max(value) FILTER (attribute = 'color') AS color,
  max(value) FILTER (attribute = 'material') AS material FROM merged GROUP BY 1)
  SELECT product_id, color, material, filled, conflicts,
  {S.r('0.5 * filled / 11.0 + 0.3 * confidence + 0.2 * (1 - conflicts / filled::DOUBLE)', 6)} AS quality_score FROM w""")
def quality_scores(spark, sf):
    wide = E.attribute_columns(E.merge_attributes(_predictions(spark, sf)))
    return E.quality_score(wide).select(
        "product_id", "color", "material", "filled", "conflicts",
        N.rounded(F.col("quality_score"), 6).alias("quality_score"))


@query(f"""WITH {S.text_tags()}, {PIXELS},
alltags AS (SELECT product_id, tag, confidence, 'text' AS source, ord FROM tags
  UNION ALL SELECT image_id, orientation, 0.7::DOUBLE, 'image', 1000 FROM stats
  UNION ALL SELECT image_id, brightness_bucket, 0.7::DOUBLE, 'image', 1001 FROM stats
  UNION ALL SELECT image_id, resolution, 0.7::DOUBLE, 'image', 1002 FROM stats
  UNION ALL SELECT image_id, color_name, 0.7::DOUBLE, 'image', 1003 FROM stats),
m AS (SELECT product_id, tag, max(confidence) AS confidence, CASE WHEN count(DISTINCT source) > 1 THEN 'hybrid'
  ELSE min(source) END AS source, min(ord) AS ord FROM alltags GROUP BY 1, 2)
SELECT product_id, tag, confidence, source, CAST(row_number() OVER (PARTITION BY product_id
  ORDER BY confidence DESC, ord, tag) AS INTEGER) AS rank FROM m QUALIFY rank <= 20""")
def merged_tags(spark, sf):
    tags = E.text_tags(T.submitted(spark, sf)).unionByName(I.image_tags(_stats(spark, sf)))
    return E.merge_tags(tags)


@query(f"""WITH {S.CATALOG}, t AS (SELECT product_id, concat_ws('. ', name, brand, category) AS text FROM catalog),
w AS (SELECT product_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket, count(*) AS n FROM
  (SELECT product_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM t) WHERE w <> '' GROUP BY ALL),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM t) + 1.0::DOUBLE) / (count(*) + 1)) AS idf FROM w GROUP BY 1),
x AS (SELECT product_id, bucket, n * idf AS v FROM w JOIN idf USING (bucket))
SELECT product_id, bucket, {S.r('CAST(v / sqrt(sum(v * v) OVER (PARTITION BY product_id)) AS FLOAT)', 5)} AS value FROM x WHERE v <> 0""")
def text_embeddings(spark, sf):
    """All entries of the catalog's text vectors that are not zero."""
    texts = J.product_texts(T.catalog(spark, sf))
    vectors = hashed_text_vectors(texts, fit_text_weights(texts))
    return vectors.select("product_id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0").select(
        "product_id", "bucket", N.rounded(F.col("value"), 5).alias("value"))


LETTERS = "[" + ", ".join(f"list_sum(list_transform(string_split(t, ''), lambda c: ((ord(c) * {d}) % 7 - 3)::DOUBLE))" for d in range(1, 9)) + "]"


def _entries(vectors, key="product_id"):
    return vectors.select(key, F.posexplode("vector").alias("i", "value")).select(
        key, F.col("i").cast("long").alias("i"), N.rounded(F.col("value"), 5).alias("value"))


@query(f"""WITH e AS (SELECT product_id, {LETTERS} AS v FROM (SELECT p_partkey AS product_id, concat_ws('. ', p_name, p_brand, p_type) AS t FROM part)),
  n AS (SELECT product_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e)
  SELECT product_id, i - 1 AS i, {S.r('(v[i] / CASE WHEN norm = 0 THEN 1 ELSE norm END)::FLOAT', 5)} AS value FROM n, range(1, 9) t(i)""")
def embed_model(spark, sf):
    """Text vectors from a model that is loaded once a worker."""
    embed = model_embedder(letter_model(8))
    return _entries(J.product_texts(T.catalog(spark, sf)).select("product_id", embed(F.col("text")).alias("vector")))


@query(f"""WITH {PIXELS}, q AS (SELECT image_id, (y // 4) * 2 + x // 4 AS k, [avg(r), avg(g), avg(b)] AS m FROM px GROUP BY 1, 2),
  v AS (SELECT image_id, flatten(list(m ORDER BY k)) AS v FROM q GROUP BY 1)
  SELECT image_id, i - 1 AS i, {S.r('(v[i] / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END)::FLOAT', 5)} AS value
  FROM v, range(1, 13) t(i)""")
def image_model(spark, sf):
    """Image vectors from a model over pixel arrays, loaded once a worker."""
    embed = model_embedder(quarter_model(T.PIXEL_SIDE), IMAGE_BATCH, [T.PIXEL_SIDE * T.PIXEL_SIDE * 3])
    arrays = I.pixel_arrays(T.pixels(spark, sf), T.PIXEL_SIDE)
    return _entries(arrays.select("image_id", embed(F.col("pixels")).alias("vector")), "image_id")


def _old_payloads(spark, sf):
    """Parts as payloads of an older make: blanks, a price as text, no keys, tags or scores."""
    size = F.col("p_size")
    return T.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), "p_name", F.when(size % 4 == 0, "  ").otherwise(
            F.col("p_brand")).alias("brand"), F.when(size % 5 != 0, F.col("p_type")).alias("category"),
        F.when(size % 6 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price")).withColumnRenamed("p_name", "name")


@query(f"""WITH o AS (SELECT p_partkey::VARCHAR AS product_id, p_name AS name, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS brand,
  CASE WHEN p_size % 5 <> 0 THEN p_type END AS category, CASE WHEN p_size % 6 <> 0 THEN p_retailprice::DOUBLE END AS price FROM part)
  SELECT product_id, name, brand, category, {S.r('price', 4)} AS price, {S.facet('brand')} AS brand_key, {S.facet('category')} AS category_key,
  0 AS n_tags FROM o""")
def read_products(spark, sf):
    """Stored products of an older make, written as JSON and read with coercion."""
    path = working_dir(spark, "payloads")
    _old_payloads(spark, sf).write.json(path)
    out = C.read_products(spark, path, "json")
    return out.select("product_id", "name", "brand", "category", N.rounded(F.col("price"), 4).alias("price"), "brand_key",
                      "category_key", F.size("tags").alias("n_tags"))


@query(f"""WITH {S.CATALOG} SELECT DISTINCT l_partkey AS product_id, name, brand, category, price FROM lineitem JOIN catalog ON product_id = l_partkey""")
def retrieve(spark, sf):
    """The payload of every ordered product."""
    asked = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id")).distinct()
    return K.retrieve(asked, T.catalog(spark, sf)).select("product_id", "name", "brand", "category", "price")


@query()
def price_described(spark, sf):
    """Text embedding, text search and pricing of every catalog product by its description."""
    catalog = T.catalog(spark, sf)
    texts = J.product_texts(catalog)
    weights = fit_text_weights(texts)

    def embed(asked):
        return hashed_text_vectors(asked, weights, key="query_id")

    priced = J.price_described(catalog, hashed_text_vectors(texts, weights), catalog, embed)
    return priced.drop("comparables", "relevant_count")


@query(f"""WITH {PIXELS}, h AS (SELECT image_id, r // 32 * 64 + g // 32 * 8 + b // 32 AS cell, count(*) AS n FROM px GROUP BY ALL),
  nm AS (SELECT image_id, sqrt(sum(n * n)) AS norm FROM h GROUP BY 1),
  dots AS (SELECT a.image_id AS query_id, b.image_id AS product_id, sum(a.n * b.n) AS d FROM h a JOIN h b USING (cell) GROUP BY 1, 2),
  s AS (SELECT q.image_id AS query_id, p.image_id AS product_id, coalesce(d, 0) / (q.norm * p.norm) AS score FROM nm q CROSS JOIN nm p
  LEFT JOIN dots ON dots.query_id = q.image_id AND dots.product_id = p.image_id WHERE q.image_id <> p.image_id)
  SELECT query_id, product_id, {S.r('score', 6)} AS score, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, product_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def knn_color(spark, sf):
    """Nearest images by their default color vectors."""
    vectors = I.color_histogram(T.pixels(spark, sf)).withColumnRenamed("image_id", "product_id")
    hits = knn_join(vectors.withColumnRenamed("product_id", "query_id"), vectors, 5, exclude_self=True)
    return hits.withColumn("score", N.rounded(F.col("score"), 6))
