"""Usage analytics, quotas, audit, job state, model registry and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import frames as T
from registry import sql as S
from registry.core import SQL, query
from vitrine.config import UsageConfig
from vitrine.functions import scalars as N
from vitrine.operators import filters as L
from vitrine.operators import jobs as B
from vitrine.operators import registry as M
from vitrine.operators import usage as U
from vitrine.plans import catalog_jobs as J
from vitrine.session import working_dir
from vitrine.sources.catalog import PAYLOAD
from vitrine.streaming import quota as SQ
from vitrine.streaming import upsert as SU
from vitrine.streaming import usage as ST

END = "2024-01-30"
CFG = UsageConfig(daily_quota=4, minute_quota=1, audit_cap=50, audit_limit=30)

EVENTS = """ev AS (SELECT event_id, ts, user_id AS tenant_id, CASE event_type WHEN 'signup' THEN 'upload' WHEN 'click' THEN 'duplicate_check'
  WHEN 'purchase' THEN 'recommendation' WHEN 'view' THEN 'search' ELSE 'error' END AS event_type,
  CASE WHEN event_type = 'signup' THEN value END AS seconds, ts::DATE AS day FROM events)"""


def _daily(spark, sf):
    return U.daily_counters(T.usage_events(spark, sf))


@query(f"""WITH {EVENTS} SELECT event_type, day, count(*) AS n, {S.r('coalesce(sum(seconds), 0)', 4)} AS latency_sum,
  count(seconds) AS latency_n FROM ev GROUP BY 1, 2""")
def daily_counters(spark, sf):
    return _daily(spark, sf).withColumn("latency_sum", N.rounded(F.col("latency_sum"), 4))


def _window(days: int, prefix: str = "", end: str = END) -> str:
    inside = f"day > DATE '{end}' - {days} AND day <= DATE '{end}'"
    counts = ", ".join(f"count(*) FILTER (event_type = '{e}' AND {inside}) AS {prefix}{e}" for e in U.COUNTED_EVENTS)
    return f"{counts}, {S.r(f'coalesce(avg(seconds) FILTER ({inside}), 0)', 4)} AS {prefix}average_seconds"


@query(f"WITH {EVENTS} SELECT {_window(7)} FROM ev")
def usage_window(spark, sf):
    return U.usage(_daily(spark, sf), END, 7)


@query(f"""WITH {EVENTS} SELECT {_window(1, 'today_')}, {_window(7, 'window_')}, 7 AS window_days,
  (SELECT count(*) FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0)) AS active_models FROM ev""")
def dashboard(spark, sf):
    return U.dashboard(_daily(spark, sf), END, _models(spark, sf))


@query(f"""WITH {EVENTS} SELECT 'last 14 days' AS period, DATE '{END}' - 13 AS start_date, DATE '{END}' AS end_date, {_window(14)} FROM ev""")
def labeled_report(spark, sf):
    return U.labeled_report(_daily(spark, sf), END, 14, "last 14 days")


@query(f"""WITH {EVENTS} SELECT day, event_type, count(*) AS n FROM ev WHERE day > DATE '{END}' - 10 AND day <= DATE '{END}' GROUP BY 1, 2""")
def retention(spark, sf):
    return U.retained(_daily(spark, sf), END, 10).select("day", "event_type", "n")


def _trend_sql(days: int, periods: int) -> str:
    return f"""{EVENTS}, spine AS (SELECT DISTINCT event_type, unnest(range(0, {periods})) AS back FROM ev),
sums AS (SELECT event_type, date_diff('day', day, DATE '{END}') // {days} AS back, count(*) AS n FROM ev WHERE day <= DATE '{END}' GROUP BY 1, 2),
pts AS (SELECT event_type, DATE '{END}' - CAST((back + 1) * {days} - 1 AS INTEGER) AS period_start, coalesce(n, 0)::DOUBLE AS value
  FROM spine LEFT JOIN sums USING (event_type, back))"""


def _trend(granularity, periods):
    return lambda spark, sf: U.trend(_daily(spark, sf), granularity, periods, END)


for _granularity, _days, _periods in (("daily", 1, 35), ("weekly", 7, 6), ("monthly", 30, 3)):
    query(f"WITH {_trend_sql(_days, _periods)} SELECT * FROM pts", f"trend_{_granularity}")(
        _trend(_granularity, _periods))


@query(f"""WITH {_trend_sql(7, 6)} SELECT event_type, array_to_string(list_concat(['# ' || CASE event_type WHEN 'duplicate_check' THEN 'Duplicate_Check'
  ELSE upper(left(event_type, 1)) || substr(event_type, 2) END || ' trend (weekly)', '', '| Period start | Value |', '|---|---|'],
  list('| ' || period_start || ' | ' || value::BIGINT || ' |' ORDER BY period_start), ['']), chr(10)) AS markdown FROM pts GROUP BY event_type""")
def trend_markdown(spark, sf):
    return U.trend_markdown(U.trend(_daily(spark, sf), "weekly", 6, END), "weekly")


@query(f"""WITH {EVENTS}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM ev),
spine AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT event_type FROM ev), b),
d AS (SELECT event_type, day, count(*) AS n FROM ev GROUP BY 1, 2), f AS (SELECT event_type, day, coalesce(n, 0) AS n FROM spine LEFT JOIN d USING (event_type, day))
SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM f""")
def trailing_usage(spark, sf):
    return U.trailing_usage(_daily(spark, sf), 7)


def _requests(spark, sf):
    return T.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("tenant_id"), "ts")


@query("""SELECT event_id AS request_id, user_id AS tenant_id,
  row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS minute_count,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS daily_count,
  CASE WHEN daily_count > 4 THEN 'daily_quota' WHEN minute_count > 1 THEN 'rate_limit' END AS verdict FROM events""")
def quota_hits(spark, sf):
    return U.quota_hits(_requests(spark, sf), CFG).select(
        "request_id", "tenant_id", "minute_count", "daily_count", "verdict")


@query("""SELECT tenant_id, day, requests, tenant_id % 3 * 2 AS daily_quota,
  CASE WHEN tenant_id % 3 > 0 THEN greatest(tenant_id % 3 * 2 - requests, 0) END AS remaining,
  tenant_id % 3 > 0 AND requests > tenant_id % 3 * 2 AS "over"
  FROM (SELECT user_id AS tenant_id, ts::DATE AS day, count(*) AS requests FROM events GROUP BY 1, 2)""")
def quota_usage(spark, sf):
    requests = _requests(spark, sf)
    limits = requests.select("tenant_id").distinct().withColumn("daily_quota", F.col("tenant_id") % 3 * 2)
    return U.quota_usage(requests, limits)


def _audit(spark, sf):
    return T.table(spark, sf, "events").select(
        F.col("user_id").alias("tenant_id"), "event_id", F.col("event_type").alias("action"),
        F.concat(F.lit("User-"), (F.col("event_id") % 7).cast("string")).alias("actor"),
        F.col("ts").alias("created_at"), F.from_json("props", "map<string,string>").alias("metadata"))


@query("""SELECT user_id AS tenant_id, event_id, event_type AS action, props->>'k' AS k, CAST(row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 30""")
def audit_recent(spark, sf):
    return U.recent_audit(_audit(spark, sf), CFG).select(
        "tenant_id", "event_id", "action", F.col("metadata")["k"].alias("k"), "rank")


@query("""SELECT event_id, event_type AS action FROM events WHERE event_type = 'error' AND 'user-' || event_id % 7 LIKE '%r-3%'""")
def audit_view(spark, sf):
    return L.audit_view(_audit(spark, sf), action="error", actor=" R-3 ").select("event_id", "action")


@query("SELECT DISTINCT event_type AS action FROM events")
def audit_actions(spark, sf):
    return U.audit_actions(_audit(spark, sf))


@query("""SELECT user_id, event_type AS mode, query, CAST(row_number() OVER (PARTITION BY user_id
  ORDER BY latest DESC, event_type, query) AS INTEGER) AS rank FROM (SELECT user_id, event_type, props->>'k' AS query, max(ts) AS latest
  FROM events GROUP BY ALL) QUALIFY rank <= 20""")
def search_history(spark, sf):
    searches = T.table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("mode"),
        F.get_json_object("props", "$.k").alias("query"), F.col("ts").alias("at"))
    return U.search_history(searches, ["mode", "query"]).select("user_id", "mode", "query", "rank")


@query("""SELECT event_type AS label, CASE WHEN value > 10 THEN 'slow' ELSE 'ok' END AS outcome, count(*) AS n,
  CAST(round(CAST(sum(value) AS DECIMAL(28,10)), 4) AS DOUBLE) AS total, count(*) FILTER (value <= 0.5) AS le_0, count(*) FILTER (value <= 2.5) AS le_1,
  count(*) FILTER (value <= 10) AS le_2, count(*) FILTER (value <= 60) AS le_3 FROM events GROUP BY 1, 2""")
def ops_histogram(spark, sf):
    ops = T.table(spark, sf, "events").select(
        F.col("event_type").alias("label"), F.when(F.col("value") > 10, "slow").otherwise("ok")
        .alias("outcome"), "value")
    return U.distributions(ops, [0.5, 2.5, 10.0, 60.0]).withColumn("total", N.rounded(F.col("total"), 4))


@query("""SELECT label, CAST(i AS INTEGER) AS position, q[i] AS value FROM generate_series(1, 3) g(i),
  (SELECT event_type AS label, quantile_disc(value, [0.5, 0.9, 0.99]) AS q FROM events GROUP BY 1)""")
def ops_quantiles(spark, sf):
    ops = T.table(spark, sf, "events").select(F.col("event_type").alias("label"), "value")
    out = U.approximate_quantiles(ops, [0.5, 0.9, 0.99], accuracy=1_000_000)
    return out.select("label", F.posexplode("quantiles").alias("position", "value")).withColumn(
        "position", F.col("position") + 1)


@query("""WITH w AS (SELECT event_type AS label, value, ts::DATE + unnest(generate_series(0, 6))::INTEGER AS day FROM events WHERE value IS NOT NULL)
  SELECT label, CAST(day AS DATE) AS day, count(*) AS n, quantile_disc(value, 0.5)::DOUBLE AS p50, quantile_disc(value, 0.9)::DOUBLE AS p90,
  quantile_disc(value, 0.99)::DOUBLE AS p99 FROM w WHERE day <= (SELECT max(ts::DATE) FROM events WHERE value IS NOT NULL) GROUP BY 1, 2""")
def ops_quantiles_trailing(spark, sf):
    """Quantiles of the last seven days for each label and day, from daily sketches."""
    ops = T.table(spark, sf, "events").select(F.col("event_type").alias("label"), "ts", "value")
    out = U.trailing_quantiles(U.daily_sketches(ops), 7, [0.5, 0.9, 0.99])
    return out.select("label", "day", "n", *(F.col("quantiles")[i].alias(c) for i, c in enumerate(("p50", "p90", "p99"))))


# ---------------------------------------------------------------- jobs

STATES = """a AS (SELECT user_id AS job_id, ts, event_id, event_type <> 'error' AS ok, props,
  count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS failures FROM events),
fin AS (SELECT job_id, min(struct_pack(t := ts, i := event_id)) AS last FROM a WHERE ok OR failures > 5 GROUP BY 1),
lived AS (SELECT a.*, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS back FROM a LEFT JOIN fin USING (job_id)
  WHERE last IS NULL OR struct_pack(t := ts, i := event_id) <= last),
states AS (SELECT job_id, failures AS retry_count, CASE WHEN ok THEN 'completed' WHEN failures > 5 THEN 'failed' ELSE 'retrying' END AS status,
  CASE WHEN NOT ok THEN 'failed ' || props END AS error FROM lived WHERE back = 1)"""


@query(f"""WITH {STATES} SELECT job_id, retry_count, error, status, CASE WHEN status = 'retrying' THEN 5.0::DOUBLE * 2.0::DOUBLE ** (retry_count - 1) END
  AS delay_seconds, status = 'failed' AS dead_letter FROM states""")
def job_state(spark, sf):
    return B.job_state(T.attempts(spark, sf)).select(
        "job_id", "retry_count", "error", "status", "delay_seconds", "dead_letter")


@query(f"WITH {STATES} SELECT status, count(*) AS jobs FROM states GROUP BY 1")
def queue_stats(spark, sf):
    return B.queue_statistics(B.job_state(T.attempts(spark, sf)))


@query("""WITH l AS (SELECT user_id AS job_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS e, max(ts) AS since FROM events GROUP BY 1),
  n AS (SELECT max(ts) AS now FROM events)
  SELECT job_id, (epoch_us(now) - epoch_us(since)) // 1000000 AS age_seconds FROM l, n WHERE e IN ('view', 'click') AND age_seconds >= 300""")
def stale_jobs(spark, sf):
    events = T.table(spark, sf, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "running").when(
        F.col("event_type") == "error", "retrying").otherwise("completed")
    log = events.select(F.col("user_id").alias("job_id"), status.alias("status"),
                        F.col("ts").alias("at"), "event_id")
    return B.stale_jobs(B.latest_status(log), events.agg(F.max("ts")).scalar()).select(
        "job_id", "age_seconds")


# ---------------------------------------------------------------- model registry


def _models(spark, sf):
    """Customers as model versions of their segment; orders switch versions on and off."""
    customer = T.table(spark, sf, "customer")
    registrations = customer.select(
        F.col("c_mktsegment").alias("model_type"), F.col("c_custkey").alias("version"),
        F.col("c_name").alias("model_name"),
        F.when(F.col("c_acctbal") > 0, "active").otherwise("inactive").alias("status"),
        F.col("c_custkey").alias("at"))
    return M.current_models(registrations, registrations.limit(0).select(
        "model_type", "version", F.lit("activate").alias("action"), "at"))


def _switched_models(spark, sf):
    customer = T.table(spark, sf, "customer")
    registrations = customer.select(
        F.col("c_mktsegment").alias("model_type"), F.col("c_custkey").alias("version"),
        F.col("c_name").alias("model_name"), F.lit("inactive").alias("status"), F.lit(0).cast("bigint").alias("at"))
    switches = T.table(spark, sf, "orders").join(
        customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("model_type"), F.col("c_custkey").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "deactivate").otherwise("activate").alias("action"),
        F.col("o_orderkey").alias("at"))
    return M.current_models(registrations, switches)


REGISTRY = """sw AS (SELECT c_mktsegment AS model_type, c_custkey AS version, o_orderstatus = 'F' AS off, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey),
last_on AS (SELECT model_type, arg_max(version, k) AS version, max(k) AS on_at FROM sw WHERE NOT off GROUP BY 1),
act AS (SELECT o.model_type, o.version FROM last_on o WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.model_type = o.model_type AND sw.version = o.version AND off AND sw.k > on_at)),
models AS (SELECT c_mktsegment AS model_type, c_custkey AS version, c_name AS model_name, CASE WHEN act.version IS NOT NULL THEN 'active' ELSE 'inactive' END AS status
  FROM customer LEFT JOIN act ON act.model_type = c_mktsegment AND act.version = c_custkey)"""


@query(f"WITH {REGISTRY} SELECT * FROM models")
def model_registry(spark, sf):
    return _switched_models(spark, sf)


@query(f"""WITH {REGISTRY} SELECT model_type, max(model_name) FILTER (status = 'active') AS active_model,
  max(version) FILTER (status = 'active') AS active_version, count(*) AS registered_versions FROM models GROUP BY 1""")
def model_usage(spark, sf):
    types = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("model_type")).distinct()
    return M.model_usage(types, _switched_models(spark, sf))


# ---------------------------------------------------------------- ingest

INGESTED = f"""{S.text_tags()}, w AS (SELECT product_id, count(*) AS filled, avg(confidence) AS confidence,
  max(value) FILTER (attribute = 'color') AS color, max(value) FILTER (attribute = 'style') AS style FROM attrs GROUP BY 1),
tg AS (SELECT product_id, array_to_string(list(tag ORDER BY rk), ',') AS tags FROM (SELECT product_id, tag, row_number() OVER (
  PARTITION BY product_id ORDER BY confidence DESC, ord, tag) AS rk FROM tags WHERE confidence >= 0.6) WHERE rk <= 20 GROUP BY 1),
ok AS (SELECT * FROM submitted WHERE price >= 0 AND coalesce(length(description), 0) <= 2000)"""


@query(f"""WITH {INGESTED} SELECT p.p_partkey AS product_id, coalesce(ok.name, 'old ' || p_name) AS name, w.color, w.style, CASE WHEN ok.product_id IS NOT NULL THEN coalesce(tg.tags, '') END AS tags,
  CASE WHEN ok.product_id IS NOT NULL THEN {S.r('0.5 * coalesce(filled, 0) / 11.0 + 0.3 * coalesce(confidence, 0) + 0.2', 6)} END AS quality_score
  FROM part p LEFT JOIN ok ON ok.product_id = p_partkey LEFT JOIN w ON w.product_id = ok.product_id LEFT JOIN tg ON tg.product_id = ok.product_id""")
def ingest(spark, sf):
    """All submitted parts into a catalog that holds an older version of each."""
    raw = T.submitted(spark, sf).withColumn("version", F.lit(1))
    kinds = {f.name: f.dataType for f in PAYLOAD.fields}
    old = T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.concat(F.lit("old "), "p_name").alias("name"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in (
            "brand", "category", "description", "price", "brand_key", "category_key", "color",
            "material", "gender", "season", "style", "tags", "quality_score")],
        F.lit(0).alias("version"))
    stored, _rejected = J.ingest(raw, old, None, mode="off")
    return stored.select("product_id", "name", "color", "style", F.array_join("tags", ",").alias("tags"),
                         N.rounded(F.col("quality_score"), 6).alias("quality_score"))


# ---------------------------------------------------------------- streams


@query("""SELECT ts::DATE AS day, event_type, count(*) AS n, CAST(round(CAST(sum(value) AS DECIMAL(28,10)), 4) AS DOUBLE) AS latency_sum, count(value) AS latency_n
  FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark, sf):
    """All days, the open one too."""
    T.prepare(spark)
    out = ST.run_updates(ST.daily_counters(ST.read_events(spark, sf)), "daily", "day", "event_type")
    return out.withColumn("latency_sum", N.rounded(F.col("latency_sum"), 4))


def _rate_sql(unit: str) -> str:
    return f"""SELECT user_id AS tenant_id, strftime(time_bucket(INTERVAL 1 {unit}, ts), '%Y-%m-%d %H:%M') AS window_start,
  count(*) AS n, count(*) > 1 AS over_limit FROM events GROUP BY 1, 2"""


def _rates(spark, sf, width):
    T.prepare(spark)
    counts = ST.rate_counters(ST.read_events(spark, sf), "user_id", 1, width=width)
    return ST.run_updates(counts, "rate", "tenant_id", "window_start").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(_rate_sql("HOUR"))
def stream_rate_counts(spark, sf):
    return _rates(spark, sf, "1 hour")


@query(_rate_sql("MINUTE"))
def stream_rate_minute(spark, sf):
    return _rates(spark, sf, "1 minute")


@query(_rate_sql("DAY"))
def stream_rate_day(spark, sf):
    return _rates(spark, sf, "1 day")


@query("""WITH d AS (SELECT event_type, unnest(generate_series(0, 6))::INTEGER + ts::DATE AS day FROM events)
  SELECT CAST(day AS DATE) AS day, event_type, count(*) AS n FROM d GROUP BY 1, 2""")
def stream_trailing_counts(spark, sf):
    T.prepare(spark)
    return ST.run_updates(ST.trailing_counters(ST.read_events(spark, sf)), "trailing", "day", "event_type")


@query(SQL["quota_hits"])
def stream_quota_hits(spark, sf):
    """A verdict for every request as it arrives; counters are state that expires."""
    T.prepare(spark)
    requests = ST.read_events(spark, sf).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("tenant_id"), "ts")
    return SQ.run(requests, working_dir(spark, "quota"), CFG)


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf):
    """Every event delivered twice comes out once."""
    T.prepare(spark)
    events = ST.read_events(spark, sf)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return ST.run_available(ST.once_per_id(twice, delay="40 days"), "dedup").select("event_id", "event_type")


@query("""SELECT user_id AS product_id, event_id AS version, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_upsert(spark, sf):
    T.prepare(spark)
    rows = ST.read_events(spark, sf).select(
        F.col("user_id").alias("product_id"), F.col("event_id").alias("version"), "event_type")
    base = working_dir(spark, "upsert")
    SU.start_upsert(rows, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return SU.current(spark, f"{base}/table", rows.schema)
