"""Evaluation of a whole dataset: each entry goes to its task's route, and one that fails stays as a row.

A route takes the entries of its task and returns ranked lists; it is part of the plan like any other join. What can fail
is known before: an entry that is malformed, one whose product is not indexed, one whose task has no route or a route
that cannot be set up. Such entries keep their error and count as failures of their task; the others are not affected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators import evaluate as V
from vitrine.operators.filters import subset
from vitrine.sources.evaluation import TASKS

#: From entries (query_id, text, image_path, product_id, top_k) to (query_id, product_id, rank).
Route = Callable[[DataFrame], DataFrame]


def checked_entries(parsed: DataFrame, indexed: DataFrame, *, ids: list[str] | None = None,
                    limit: int | None = None) -> DataFrame:
    """Entries of ``parse_dataset`` with ``error`` (null where the entry can run): the ``ids`` first, then ``limit``.

    ``indexed`` has the ``product_id`` of every product that can be asked about.
    """
    entries = parsed.filter(F.col("raw").isNotNull() | ~F.col("is_array"))
    entries = subset(entries, ids=ids, limit=limit)
    known = indexed.select(F.col("product_id").cast("string").alias("product_id"), F.lit(True).alias("_known"))
    asked = F.col("task_type") != "retrieval"
    missing = F.concat(F.lit("product "), F.col("product_id"), F.lit(" is not indexed"))
    return entries.join(known, "product_id", "left").withColumn("error", F.coalesce(
        F.col("problem"), F.when(asked & F.col("_known").isNull(), missing))).drop("_known")


def evaluate_entries(entries: DataFrame, routes: dict[str, Route]) -> DataFrame:
    """Per entry its task, error and metrics; the ranked lists of all routes meet in one table.

    ``entries`` comes from ``checked_entries``. A task without a route, or whose route cannot be set up, fails with all
    its entries.
    """
    ranked, broken = None, {}
    for task in TASKS:
        mine = entries.filter((F.col("task_type") == task) & F.col("error").isNull())
        try:
            hits = routes[task](mine).select(
                "query_id", F.col("product_id").cast("string").alias("product_id"), "rank")
        except KeyError:
            broken[task] = f"no route for {task}"
            continue
        except Exception as error:  # whatever a route raises is its own entries' error
            broken[task] = f"{type(error).__name__}: {error}"
            continue
        ranked = hits if ranked is None else ranked.unionByName(hits)
    error = F.col("error")
    for task, message in broken.items():
        error = F.coalesce(error, F.when(F.col("task_type") == task, F.lit(message)))
    expected = entries.select("query_id", F.explode("expected_products").alias("product_id"))
    asked = entries.select("query_id", "task_type", error.alias("error"), F.lit(0.0).alias("latency_seconds")).join(
        V.expected_counts(expected), "query_id", "left").na.fill(0, ["n_expected"])
    if ranked is None:
        ranked = expected.select("query_id", "product_id", F.lit(1).alias("rank")).limit(0)
    return V.query_metrics(asked, V.flag_relevance(ranked, expected))


def evaluate_dataset(parsed: DataFrame, indexed: DataFrame, routes: dict[str, Route], *, ids: list[str] | None = None,
                     limit: int | None = None) -> DataFrame:
    """The report by task: metrics of the entries that ran, and how many failed."""
    return V.task_metrics(evaluate_entries(checked_entries(parsed, indexed, ids=ids, limit=limit), routes))
