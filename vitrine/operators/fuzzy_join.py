"""All pairs of texts whose fuzzy ratio reaches a threshold, without comparing all pairs.

The ratio is 2 * c / (m + n) for a longest common subsequence of c of the m and n characters. Three bounds come before
it, none of which loses a pair:

- length: c is at most the shorter length, so n lies between m * t / (2 - t) and m * (2 - t) / t;
- prefix: of m characters, numbered so that equal ones differ, m * t / (2 - t) are common at least; of the m - 1 pairs
  of neighboring characters (1.5 * t - 1) * 2 * m / (2 - t) - 1, since a character left out breaks at most two of them
  and one put in one. Two texts with so much in common share one of the rarest entries of each, as many as may differ
  and one more. Pairs of characters are used where that number is at least 1, characters for short texts;
- count: the numbers of common characters and of common pairs of characters, taken exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.fuzzy import pieces, token_similarity
from vitrine.session import materialize

SLACK = 1e-9


def _least_letters(n: Column, t: float) -> Column:
    return n * (t / (2 - t))


def _least_neighbors(n: Column, t: float) -> Column:
    return n * ((1.5 * t - 1) * 2 / (2 - t)) - 1


def _prefixes(values: DataFrame, t: float) -> DataFrame:
    """(value, n, entry): the rarest entries of each value, one of which any partner shares."""
    n = F.col("n")
    long = math.ceil((2 - t) / (1.5 * t - 1) - SLACK) if 1.5 * t - 1 > SLACK else None
    letters = pieces(F.col("value"), 1)
    if long is None:
        sets = F.array(F.struct(F.lit("c").alias("kind"), letters.alias("entries")))
    else:  # what a short text can be matched with is looked for by characters, too
        sets = F.array_compact(F.array(
            F.when(n >= long, F.struct(F.lit("g").alias("kind"), pieces(F.col("value"), 2).alias("entries"))),
            F.when(n <= math.floor((long - 1) * (2 - t) / t + SLACK), F.struct(
                F.lit("c").alias("kind"), letters.alias("entries")))))
    rows = values.select("value", "n", F.explode(sets).alias("s")).select(
        "value", "n", F.col("s.kind").alias("kind"), F.explode("s.entries").alias("entry"))
    often = rows.groupBy("kind", "entry").agg(F.count("*").alias("often"))
    order = Window.partitionBy("value", "kind").orderBy("often", "entry")
    kept = F.when(F.col("kind") == "c", n - F.ceil(_least_letters(n, t) - SLACK) + 1).otherwise(
        n - 1 - F.ceil(_least_neighbors(n, t) - SLACK) + 1)
    return rows.join(often, ["kind", "entry"]).withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= kept).select("value", "n", F.concat("kind", "entry").alias("entry"))


def candidates(values: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the pairs of different values that pass all bounds; ``values`` has ``value``, see below."""
    distinct = materialize(values.select("value").where("value is not null").distinct().withColumn(
        "n", F.length("value")), "values")
    rare = materialize(_prefixes(distinct, threshold), "prefixes")
    left = rare.select("entry", F.col("value").alias("a"), F.col("n").alias("m"))
    right = rare.select("entry", F.col("value").alias("b"), "n")
    near = F.least("m", "n") >= _least_letters(F.greatest("m", "n"), threshold) - SLACK
    met = left.join(right, "entry").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    sets = distinct.select("value", "n", pieces(F.col("value"), 1).alias("letters"), pieces(F.col("value"), 2).alias("beside"))
    for side in ("a", "b"):
        met = met.join(sets.select(F.col("value").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in (
            "n", "letters", "beside"))), side)
    total = F.col("n_a") + F.col("n_b")
    common = F.size(F.array_intersect("letters_a", "letters_b"))
    beside = F.size(F.array_intersect("beside_a", "beside_b"))
    return met.where((2 * common >= threshold * total - SLACK)
                     & (beside >= (1.5 * threshold - 1) * total - 1 - SLACK)).select("a", "b")


def similar_values(values: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of different values whose ratio is ``threshold`` or more.

    ``values`` has a column ``value`` in the form of ``sorted_tokens``; nulls match nothing. The threshold is more than 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and not above 1")
    scored = candidates(values, threshold).withColumn("similarity", token_similarity(F.col("a"), F.col("b")))
    return scored.where(F.col("similarity") >= threshold)
