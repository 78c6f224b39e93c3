"""Column helpers: normalization, clamping, rounding and text formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.config import SCORE_DECIMALS

EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` removes only blanks)."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def fold(c: Column) -> Column:
    """Stripped lower case, null when blank: the form in which values are compared."""
    return F.lower(blank_to_null(c))


def same_text(a: Column, b: Column) -> Column:
    """True when both sides are non-blank and equal ignoring case and outer space."""
    return F.coalesce(fold(a) == fold(b), F.lit(False))


def facet_key(c: Column) -> Column:
    """Canonical facet key: folded, separator runs become one hyphen, empty becomes null."""
    folded = F.replace(F.lower(strip(c)), F.lit("ß"), F.lit("ss"))
    slug = F.regexp_replace(folded, "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit(""))


def text_representation(name: Column, brand: Column, category: Column, description: Column) -> Column:
    """Name, then the non-blank brand, category and description, joined by ``". "``."""
    rest = [blank_to_null(c) for c in (brand, category, description)]
    return F.concat_ws(". ", F.coalesce(strip(name), F.lit("")), *rest)


def payload_text(product_id: Column, name: Column, brand: Column, category: Column,
                 description: Column) -> Column:
    """Text of a stored product; its id when nothing usable is stored."""
    parts = [blank_to_null(c) for c in (name, brand, category, description)]
    return F.coalesce(F.nullif(F.concat_ws(". ", *parts), F.lit("")), product_id.cast("string"))


def l2_normalize(v: Column) -> Column:
    as_double = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(as_double, lambda x: x / norm)).otherwise(as_double)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def rounded(c: Column, digits: int) -> Column:
    """Half-up rounding after binary noise beyond ten decimals is dropped."""
    return F.round(c.cast("decimal(28,10)"), digits).cast("double")


def rank_value(score: Column) -> Column:
    """The value scores are ordered by."""
    return F.round(score, SCORE_DECIMALS)


def percent(c: Column) -> Column:
    """``0.873`` as ``87%``."""
    return F.concat(rounded(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def fixed(c: Column, digits: int) -> Column:
    """A number with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", rounded(c, digits))


def signed(c: Column, digits: int) -> Column:
    """As ``fixed``, with the sign always shown."""
    return F.format_string(f"%+.{digits}f", rounded(c, digits))


def mean_of_present(*values: Column) -> Column:
    """Mean of the non-null values, 0 when none is present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return F.coalesce(F.try_divide(total, present.cast("double")), F.lit(0.0))


def positive_price(c: Column) -> Column:
    """A usable price, or null."""
    number = c.try_cast("double")
    return F.when(number > 0, number)


def oxford_list(items: Column) -> Column:
    """``a`` / ``a and b`` / ``a, b, and c`` for an array of strings."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, last)
        .when(n == 2, F.concat(head, F.lit(" and "), last))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )


def summary_sentence(lead: Column | str, descriptions: Column) -> Column:
    """``lead: a, b, and c.``, or the lead alone when there is nothing to list."""
    lead_col = F.lit(lead) if isinstance(lead, str) else lead
    prefix = F.regexp_replace(lead_col, r"[:\s]+$", "")
    listed = F.filter(descriptions, lambda d: F.length(d) > 0)
    return (
        F.when((F.size(listed) == 0) & (prefix == ""), F.lit(""))
        .when(F.size(listed) == 0, F.concat(prefix, F.lit(".")))
        .when(prefix == "", F.concat(oxford_list(listed), F.lit(".")))
        .otherwise(F.concat(prefix, F.lit(": "), oxford_list(listed), F.lit(".")))
    )


def processed_filename(name: Column) -> Column:
    """Stem of a stored file name with the one extension processed images have."""
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(".jpg"))


def key_prefix(c: Column) -> Column:
    return F.substring(c, 1, 12)


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def tenant_scoped(prefix: Column, tenant: Column, base: Column) -> Column:
    return F.concat_ws("_", prefix, tenant, base)
