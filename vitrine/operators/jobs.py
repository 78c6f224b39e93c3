"""Job state derived from attempt and lifecycle logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.config import DEFAULTS, JobConfig


def retry_delay(retries: Column, cfg: JobConfig = DEFAULTS.jobs) -> Column:
    """Seconds to wait before the next attempt: doubled with every failure."""
    return F.lit(cfg.retry_delay_seconds) * F.pow(F.lit(2.0), (retries - 1).cast("double"))


def job_state(attempts: DataFrame, cfg: JobConfig = DEFAULTS.jobs) -> DataFrame:
    """Per job its status, failure count, last error and next delay.

    ``attempts`` is (job_id, attempt, success, error, completed_at). The first success, or the first failure beyond
    ``max_retries``, ends a job: later attempts change nothing. A completed job has no error.
    """
    # Both kinds of end are found without bringing a job's attempts together: the first success is a minimum, and of the
    # failures only the first max_retries + 1 can count, which Spark picks before the shuffle.
    last = F.struct("attempt", "completed_at", "error")
    done = attempts.where("success").groupBy("job_id").agg(F.min_by(last, "attempt").alias("_success"))
    order = Window.partitionBy("job_id").orderBy("attempt")
    failures = attempts.where(~F.col("success")).withColumn("_nth", F.row_number().over(order)).where(
        F.col("_nth") <= cfg.max_retries + 1)
    before = failures.join(done, "job_id", "left").where(
        F.col("_success").isNull() | (F.col("attempt") < F.col("_success.attempt"))).groupBy("job_id").agg(
        F.count("*").alias("retry_count"), F.max_by(last, "attempt").alias("_failure"))
    both = done.join(before, "job_id", "full").withColumns({
        "retry_count": F.coalesce("retry_count", F.lit(0).cast("bigint")),
        "_done": F.col("_success").isNotNull() & (F.coalesce("retry_count", F.lit(0)) <= cfg.max_retries)})
    end = F.when(F.col("_done"), F.col("_success")).otherwise(F.col("_failure"))
    state = both.withColumn("_end", end).select(
        "job_id", F.col("_end.attempt").alias("attempts"), "retry_count", "_done", F.col("_failure.error").alias("_error"),
        F.col("_end.completed_at").alias("updated_at"))
    status = (F.when(F.col("_done"), "completed")
              .when(F.col("retry_count") > cfg.max_retries, "failed").otherwise("retrying"))
    return state.withColumn("status", status).withColumns({
        "error": F.when(F.col("status") != "completed", F.col("_error")),
        "delay_seconds": F.when(F.col("status") == "retrying", retry_delay(F.col("retry_count"), cfg)),
        "dead_letter": F.col("status") == "failed",
    }).drop("_done", "_error")


def latest_status(lifecycle: DataFrame) -> DataFrame:
    """Newest (status, since) per job from a log of (job_id, status, at, event_id)."""
    return lifecycle.groupBy("job_id").agg(
        F.max_by(F.struct("status", F.col("at").alias("since")), F.struct("at", "event_id")).alias("s")
    ).select("job_id", "s.*")


def stale_jobs(latest: DataFrame, now: Column, cfg: JobConfig = DEFAULTS.jobs) -> DataFrame:
    """Jobs still running that started at least the time limit before ``now``."""
    age = F.timestamp_diff("SECOND", F.col("since"), now)
    return latest.filter((F.col("status") == "running") & (age >= cfg.timeout_seconds)).withColumn(
        "age_seconds", age)


def queue_statistics(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("jobs"))
