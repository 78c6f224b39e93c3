"""Usage counters, trends, quotas and operational distributions over an event table.

Every report starts from daily counters, so the raw events are aggregated once and map-side;
what follows works on (event, day) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, UsageConfig
from vitrine.functions.scalars import rounded

# Counted events and the days each trend period spans.
COUNTED_EVENTS = ("upload", "duplicate_check", "recommendation", "search")
GRANULARITY_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}


def _date(value: Column | str) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def daily_counters(events: DataFrame) -> DataFrame:
    """(event_type, day, n, latency_sum, latency_n) from events with ``ts`` and ``seconds``."""
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("latency_sum"),
        F.count("seconds").alias("latency_n"))


def retained(daily: DataFrame, end: Column | str, days: int = DEFAULTS.usage.retention_days) -> DataFrame:
    """Counters not older than the retention; on day-partitioned data this prunes partitions."""
    return daily.filter((F.col("day") > F.date_sub(_date(end), days)) & (F.col("day") <= _date(end)))


def _window_sums(end: Column, days: int, prefix: str = "") -> list[Column]:
    inside = (F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end)
    counts = [
        F.coalesce(F.sum(F.when(inside & (F.col("event_type") == e), F.col("n"))), F.lit(0))
        .alias(prefix + e) for e in COUNTED_EVENTS]
    total = F.sum(F.when(inside, F.col("latency_sum")))
    n = F.sum(F.when(inside, F.col("latency_n")))
    average = rounded(F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0)), 4)
    return [*counts, average.alias(prefix + "average_seconds")]


def usage(daily: DataFrame, end: Column | str, days: int) -> DataFrame:
    """One row: the four counts and mean latency of the last ``days`` days up to ``end``."""
    return daily.agg(*_window_sums(_date(end), days))


def dashboard(daily: DataFrame, end: Column | str, models: DataFrame | None = None,
              cfg: UsageConfig = DEFAULTS.usage) -> DataFrame:
    """Today and the trailing window in one pass, plus the count of active models."""
    end = _date(end)
    row = daily.agg(*_window_sums(end, 1, "today_"), *_window_sums(end, cfg.window_days, "window_"))
    row = row.withColumn("window_days", F.lit(cfg.window_days))
    if models is not None:
        active = models.agg(F.count_if(F.col("status") == "active")).scalar()
        row = row.withColumn("active_models", active)
    return row


def labeled_report(daily: DataFrame, end: Column | str, days: int, period: str) -> DataFrame:
    end = _date(end)
    return usage(daily, end, days).select(
        F.lit(period).alias("period"), F.date_sub(end, days - 1).alias("start_date"),
        end.alias("end_date"), "*")


def trend(daily: DataFrame, granularity: str, periods: int, end: Column | str) -> DataFrame:
    """(event_type, period_start, value) for the last ``periods`` windows, oldest first, zero filled."""
    days = GRANULARITY_DAYS[granularity]
    end = _date(end)
    back = F.floor(F.datediff(end, F.col("day")) / days)
    sums = daily.filter((F.col("day") <= end) & (back < periods)).groupBy(
        "event_type", back.cast("int").alias("back")).agg(F.sum("n").alias("n"))
    spine = daily.select("event_type").distinct().withColumn(
        "back", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    start = F.date_sub(end, (F.col("back") + 1) * days - 1)
    return spine.join(sums, ["event_type", "back"], "left").select(
        "event_type", start.alias("period_start"),
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("value"))


def trend_markdown(points: DataFrame, granularity: str) -> DataFrame:
    """One Markdown document per event; a trend has a fixed number of points."""
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")
                   ).otherwise(F.col("value").cast("string"))
    line = F.concat(F.lit("| "), F.col("period_start").cast("string"), F.lit(" | "), value, F.lit(" |"))
    title = F.array_join(F.transform(F.split("event_type", "_"), lambda w: F.initcap(w)), "_")
    rows = points.groupBy("event_type").agg(
        F.array_sort(F.collect_list(F.struct("period_start", line.alias("line")))).alias("_rows"))
    head = F.array(F.concat(F.lit("# "), title, F.lit(f" trend ({granularity})")), F.lit(""),
                   F.lit("| Period start | Value |"), F.lit("|---|---|"))
    body = F.concat(head, F.transform("_rows", lambda r: r["line"]), F.array(F.lit("")))
    return rows.select("event_type", F.array_join(body, "\n").alias("markdown"))


def trailing_usage(daily: DataFrame, days: int) -> DataFrame:
    """For every calendar day and event, the sum of the last ``days`` days."""
    bounds = daily.groupBy("event_type").agg(F.lit(1).alias("_"))
    first, last = daily.agg(F.min("day")).scalar(), daily.agg(F.max("day")).scalar()
    spine = bounds.select("event_type", F.explode(F.sequence(
        first, last, F.expr("interval 1 day"))).alias("day"))
    filled = spine.join(daily.select("event_type", "day", "n"), ["event_type", "day"], "left")
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy("event_type").orderBy(number).rangeBetween(-(days - 1), 0)
    return filled.select("event_type", "day", F.coalesce("n", F.lit(0)).alias("n")).withColumn(
        "trailing", F.sum("n").over(window))


def quota_hits(requests: DataFrame, cfg: UsageConfig = DEFAULTS.usage) -> DataFrame:
    """Each request's running number in its tenant's minute and day, and whether it is over a limit.

    Only seconds are windowed row by row; the numbers add the totals of earlier seconds, of which a day has at most
    86,400, so a tenant with most of the traffic is still split.
    """
    keyed = requests.withColumns({
        "second": F.date_trunc("second", F.col("ts")), "minute": F.date_trunc("minute", F.col("ts")),
        "day": F.to_date("ts")})
    per_second = keyed.groupBy("tenant_id", "day", "minute", "second").agg(F.count("*").alias("_n"))

    def earlier(unit: str) -> Column:
        window = Window.partitionBy("tenant_id", unit).orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    before = per_second.select("tenant_id", "second", earlier("day").alias("_day"), earlier("minute").alias("_minute"))
    inside = Window.partitionBy("tenant_id", "second").orderBy("ts", "request_id")
    numbered = keyed.withColumn("_place", F.row_number().over(inside).cast("long"))
    joined = numbered.join(before, ["tenant_id", "second"]).withColumns({
        "minute_count": F.col("_minute") + F.col("_place"), "daily_count": F.col("_day") + F.col("_place")})
    return joined.withColumn("verdict", over_limit(cfg)).drop("_place", "_day", "_minute", "second")


def over_limit(cfg: UsageConfig) -> Column:
    """Which limit a request breaks, null when none; a limit of 0 is no limit."""
    verdict = F.lit(None).cast("string")
    if cfg.minute_quota:
        verdict = F.when(F.col("minute_count") > cfg.minute_quota, "rate_limit")
    if cfg.daily_quota:
        verdict = F.when(F.col("daily_count") > cfg.daily_quota, "daily_quota").otherwise(verdict)
    return verdict


def quota_usage(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests per tenant and day next to the tenant's limit."""
    used = requests.groupBy("tenant_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"))
    return used.join(limits, "tenant_id", "left").withColumns({
        "remaining": F.when(F.col("daily_quota") > 0, F.greatest(
            F.col("daily_quota") - F.col("requests"), F.lit(0))),
        "over": F.coalesce((F.col("daily_quota") > 0) & (F.col("requests") > F.col("daily_quota")),
                           F.lit(False))})


def distributions(ops: DataFrame, bounds: list[float]) -> DataFrame:
    """Per label and outcome: count, sum and cumulative counts below each bound."""
    buckets = [F.count_if(F.col("value") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return ops.groupBy("label", "outcome").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), *buckets)


def approximate_quantiles(ops: DataFrame, at: list[float], accuracy: int = 10_000) -> DataFrame:
    return ops.groupBy("label").agg(
        F.percentile_approx("value", at, accuracy).alias("quantiles"))


#: Rank error of the daily sketches below 0.1 %; up to some thousand values they are exact.
SKETCH = 4096


def daily_sketches(ops: DataFrame, size: int = SKETCH) -> DataFrame:
    """(label, day, sketch): a quantile sketch of bounded size for the values of each label and day."""
    return ops.where("value is not null").groupBy("label", F.to_date("ts").alias("day")).agg(
        F.kll_sketch_agg_double(F.col("value").cast("double"), size).alias("sketch"))


def trailing_quantiles(daily: DataFrame, days: int, at: list[float], size: int = SKETCH) -> DataFrame:
    """For every label and day up to the last one, the quantiles ``at`` of the last ``days`` days.

    ``daily`` comes from ``daily_sketches``. Sketches add up, so the values themselves are not read again: each day's
    sketch goes into the ``days`` windows that hold the day.
    """
    last = daily.agg(F.max("day")).scalar()
    windows = daily.select("label", "sketch", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add("day", i))).alias("day")).where(F.col("day") <= last)
    merged = windows.groupBy("label", "day").agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))
    return merged.select("label", "day", F.kll_sketch_get_n_double("sketch").alias("n"), F.array(
        *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in at)).alias("quantiles"))


def recent_audit(events: DataFrame, cfg: UsageConfig = DEFAULTS.usage) -> DataFrame:
    """Newest events per tenant: the log keeps ``audit_cap``, a reader sees ``audit_limit`` of them."""
    order = Window.partitionBy("tenant_id").orderBy(
        F.col("created_at").desc(), F.col("event_id").desc())
    shown = min(cfg.audit_cap, cfg.audit_limit)
    return events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown)


def audit_actions(events: DataFrame) -> DataFrame:
    return events.select("action").distinct()


def search_history(searches: DataFrame, identity: list[str],
                   cfg: UsageConfig = DEFAULTS.usage) -> DataFrame:
    """Per user the latest run of each distinct search, newest first, at most ``history_cap``."""
    distinct = searches.groupBy("user_id", *identity).agg(F.max("at").alias("at"))
    order = Window.partitionBy("user_id").orderBy(F.col("at").desc(), *identity)
    return distinct.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= cfg.history_cap)
