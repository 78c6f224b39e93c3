"""Word-order-insensitive string similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from vitrine.functions.scalars import blank_to_null


def sorted_tokens(c: Column) -> Column:
    """Lower case, split on white space, sorted and joined again; null when blank.

    Worth computing once per product: the pair function below takes this form.
    """
    return F.array_join(F.array_sort(F.split(F.lower(blank_to_null(c)), r"(?U)\s+")), " ")


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character of ``b``."""
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & positions.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2.0 * _common_subsequence(a, b) / (len(a) + len(b))


def token_similarities(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """A struct with the similarity in [0, 1] of each pair of ``sorted_tokens`` values; null when either is missing.

    All pairs of a row go to Python in one call, and equal pairs of a batch, of whatever field, are computed once.
    """
    names = list(pairs)
    fields = StructType([StructField(n, DoubleType()) for n in names])

    @pandas_udf(fields)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known: dict[tuple[str, str], float] = {}
        out = {}
        for i, name in enumerate(names):
            a, b = rows.iloc[:, 2 * i], rows.iloc[:, 2 * i + 1]
            code, distinct = pd.MultiIndex.from_arrays([a, b]).factorize()
            values = []
            for pair in distinct:
                if pair not in known:
                    known[pair] = float("nan") if pd.isna(pair[0]) or pd.isna(pair[1]) else similarity(*pair)
                values.append(known[pair])
            out[name] = pd.Series(values, dtype="float64").reindex(code).array
        return pd.DataFrame(out).astype(object).where(lambda d: d.notna(), None)

    return run(F.struct(*(c.alias(f"{side}{i}") for i, pair in enumerate(pairs.values()) for side, c in zip("ab", pair))))


def token_similarity(a: Column, b: Column) -> Column:
    """Similarity of two ``sorted_tokens`` values in [0, 1]; null when either is missing."""
    return token_similarities({"value": (a, b)})["value"]


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """``2 * common subsequence / total length`` over sorted tokens; null when either is blank."""
    return token_similarity(sorted_tokens(a), sorted_tokens(b))


def numbered(parts: Column) -> Column:
    """The entries of an array with a number each, so that the n-th equal entry differs from the first."""
    def each(ordered: Column) -> Column:  # bound by the outer lambda, so that it is sorted once
        return F.transform(ordered, lambda c, i: F.concat(c, F.lit("\x01"), (i + 2 - F.array_position(ordered, c)).cast("string")))

    return F.transform(F.array(F.sort_array(parts)), each)[0]


def pieces(value: Column, size: int) -> Column:
    """All stretches of ``size`` characters, numbered; empty where the value is shorter."""
    last = F.length(value) - (size - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return numbered(F.transform(places, lambda i: F.substring(value, i, F.lit(size))))


def ratio_bound(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """What the ratio of two ``sorted_tokens`` values cannot exceed: a common subsequence uses common letters only.

    ``letters_*`` are ``pieces(value, 1)``, computed once for each value.
    """
    common = F.size(F.array_intersect(letters_a, letters_b))
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * common / (F.length(a) + F.length(b)))
