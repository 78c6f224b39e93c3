"""Retrieval quality: per-query metrics, task averages and report differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalars import fixed, signed

# The cutoffs metrics are reported at.
CUTOFFS = (1, 5, 10)
AT_K = ("precision", "recall", "ndcg", "hit_rate")
LABELS = {"precision": "Precision", "recall": "Recall", "ndcg": "NDCG", "hit_rate": "Hit Rate"}


def flag_relevance(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds ``relevant``: is the hit in the expected set of its query."""
    truth = expected.select("query_id", "product_id").distinct().withColumn("_hit", F.lit(True))
    return ranked.join(truth, ["query_id", "product_id"], "left").withColumn(
        "relevant", F.coalesce("_hit", F.lit(False))).drop("_hit")


def expected_counts(expected: DataFrame) -> DataFrame:
    return expected.groupBy("query_id").agg(F.count_distinct("product_id").alias("n_expected"))


def _ideal_gain(n: Column, k: int) -> Column:
    total = F.lit(0.0)
    for rank in range(k, 0, -1):
        total = F.when(n >= rank, 1.0 / F.log2(F.lit(rank + 1.0))).otherwise(0.0) + total
    return total


def query_metrics(queries: DataFrame, flagged: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """Per query precision, recall, NDCG and hit rate at each cutoff and the reciprocal rank.

    ``queries`` is (query_id, n_expected, ...); ``flagged`` is (query_id, rank, relevant).
    Precision divides by the number actually returned. All are 0 when nothing was expected.
    """
    hit, rank = F.col("relevant"), F.col("rank")
    sums = [F.min(F.when(hit, rank)).alias("_first")]
    for k in cutoffs:
        sums += [
            F.count_if(rank <= k).alias(f"_shown_{k}"),
            F.count_if(hit & (rank <= k)).alias(f"_hits_{k}"),
            F.coalesce(F.sum(F.when(hit & (rank <= k), 1.0 / F.log2(rank + 1.0))), F.lit(0.0))
            .alias(f"_gain_{k}"),
        ]
    joined = queries.join(flagged.groupBy("query_id").agg(*sums), "query_id", "left")
    n = F.col("n_expected")
    asked = n > 0

    def or_zero(c: Column) -> Column:
        return F.coalesce(F.when(asked, c), F.lit(0.0))

    metrics = {}
    for k in cutoffs:
        hits = F.col(f"_hits_{k}").cast("double")
        metrics[f"precision_at_{k}"] = or_zero(F.try_divide(hits, F.col(f"_shown_{k}").cast("double")))
        metrics[f"recall_at_{k}"] = or_zero(F.try_divide(hits, n.cast("double")))
        metrics[f"ndcg_at_{k}"] = or_zero(F.try_divide(F.col(f"_gain_{k}"), _ideal_gain(n, k)))
        metrics[f"hit_rate_at_{k}"] = or_zero((hits > 0).cast("double"))
    metrics["reciprocal_rank"] = or_zero(1.0 / F.col("_first"))
    out = joined.withColumns(metrics)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def metric_names(cutoffs=CUTOFFS) -> list[str]:
    return [f"{m}_at_{k}" for m in AT_K for k in cutoffs]


def task_metrics(per_query: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """Means per task type over the queries that ran, and the count of those that failed."""
    ok = F.col("error").isNull()
    means = [F.coalesce(F.avg(F.when(ok, F.col(m))), F.lit(0.0)).alias(m) for m in metric_names(cutoffs)]
    return per_query.groupBy("task_type").agg(
        *means,
        F.coalesce(F.avg(F.when(ok, F.col("reciprocal_rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(ok, F.col("latency_seconds"))), F.lit(0.0))
        .alias("average_latency_seconds"),
        F.count_if(ok).alias("query_count"), F.count_if(~ok).alias("failure_count"))


def long_form(summary: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """(task_type, metric, value) rows of task types with at least one evaluated query."""
    names = [*metric_names(cutoffs), "mrr", "average_latency_seconds"]
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    return summary.filter("query_count > 0").select("task_type", cells.alias("m")).select(
        "task_type", "m.*")


def report_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """after − before for every task type and metric both reports have."""
    b = before.withColumnRenamed("value", "before")
    a = after.withColumnRenamed("value", "after")
    return b.join(a, ["task_type", "metric"]).withColumn("delta", F.col("after") - F.col("before"))


def _document(rows: list[Column]) -> Column:
    return F.array_join(F.array(*rows), "\n")


def report_markdown(summary: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """One Markdown section per task type."""
    lines = [
        F.concat(F.lit("## "), F.initcap("task_type")), F.lit(""),
        F.concat(F.lit("- Queries evaluated: "), F.col("query_count").cast("string")),
        F.concat(F.lit("- MRR: "), fixed(F.col("mrr"), 4)),
        F.concat(F.lit("- Average latency: "), fixed(F.col("average_latency_seconds"), 4), F.lit("s")),
        F.lit(""), F.lit("| K | Precision@K | Recall@K | NDCG@K | Hit Rate@K |"),
        F.lit("|---|---|---|---|---|"),
    ]
    for k in sorted(cutoffs):
        cells = [fixed(F.col(f"{m}_at_{k}"), 4) for m in AT_K]
        lines.append(F.concat(F.lit(f"| {k} | "), F.concat_ws(" | ", *cells), F.lit(" |")))
    return summary.filter("query_count > 0").select(
        "task_type", _document([*lines, F.lit("")]).alias("markdown"))


def report_header(summary: DataFrame, duration_seconds: float, generated_at: str) -> DataFrame:
    """The head of the report: size, duration, failures and throughput."""
    size = F.sum(F.col("query_count") + F.col("failure_count"))
    lines = [
        F.lit("# Benchmark Report"), F.lit(""), F.lit(f"- Generated at: {generated_at}"),
        F.concat(F.lit("- Dataset size: "), size.cast("string")),
        F.lit(f"- Total duration: {duration_seconds:.4f}s"),
        F.concat(F.lit("- Failures: "), F.sum("failure_count").cast("string")),
    ]
    if duration_seconds > 0:
        lines.append(F.concat(F.lit("- Throughput: "), fixed(size / duration_seconds, 2),
                              F.lit(" queries/second")))
    return summary.agg(_document([*lines, F.lit("")]).alias("markdown"))


def comparison_markdown(difference: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """One before/after/delta table per task type."""
    values = {}
    names = ["mrr", *metric_names(cutoffs), "average_latency_seconds"]
    for n in names:
        for part in ("before", "after", "delta"):
            values[(n, part)] = F.max(F.when(F.col("metric") == n, F.col(part)))

    def line(label: str, n: str) -> Column:
        return F.concat(F.lit(f"| {label} | "), F.concat_ws(
            " | ", fixed(values[(n, "before")], 4), fixed(values[(n, "after")], 4),
            signed(values[(n, "delta")], 4)), F.lit(" |"))

    rows = [F.concat(F.lit("## "), F.initcap(F.first("task_type"))), F.lit(""),
            F.lit("| Metric | Before | After | Delta |"), F.lit("|---|---|---|---|"),
            line("MRR", "mrr")]
    rows += [line(f"{LABELS[m]}@{k}", f"{m}_at_{k}") for m in AT_K for k in sorted(cutoffs)]
    rows.append(line("Avg latency (s)", "average_latency_seconds"))
    return difference.groupBy("task_type").agg(_document([*rows, F.lit("")]).alias("markdown"))


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """Reports as JSON files, one folder per frame."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
