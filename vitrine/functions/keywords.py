"""Keyword dictionaries and their matching on product text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Match keyword -> displayed attribute value, in matching order.
BRANDS = {
    "nike": "Nike", "adidas": "Adidas", "puma": "Puma", "reebok": "Reebok",
    "under armour": "Under Armour", "new balance": "New Balance", "asics": "Asics",
    "converse": "Converse", "vans": "Vans", "fila": "Fila", "skechers": "Skechers",
    "levi's": "Levi's", "levis": "Levi's", "h&m": "H&M", "zara": "Zara", "gucci": "Gucci",
    "prada": "Prada", "gap": "Gap", "uniqlo": "Uniqlo",
}
CATEGORIES = {
    "running shoes": "Running Shoes", "running shoe": "Running Shoes", "sneakers": "Sneakers",
    "sneaker": "Sneakers", "t-shirt": "T-Shirts", "t shirt": "T-Shirts", "tshirt": "T-Shirts",
    "jeans": "Jeans", "jacket": "Jackets", "dress": "Dresses", "shorts": "Shorts",
    "hoodie": "Hoodies", "sandals": "Sandals", "boots": "Boots", "backpack": "Backpacks",
    "watch": "Watches", "sunglasses": "Sunglasses", "shirt": "Shirts",
}
COLORS = {
    "red": "Red", "blue": "Blue", "green": "Green", "black": "Black", "white": "White",
    "yellow": "Yellow", "orange": "Orange", "purple": "Purple", "pink": "Pink", "brown": "Brown",
    "grey": "Gray", "gray": "Gray", "navy": "Navy", "beige": "Beige", "maroon": "Maroon",
    "gold": "Gold", "silver": "Silver", "multicolor": "Multicolor",
}
MATERIALS = {
    "mesh": "Mesh", "cotton": "Cotton", "leather": "Leather", "polyester": "Polyester",
    "wool": "Wool", "denim": "Denim", "silk": "Silk", "nylon": "Nylon", "rubber": "Rubber",
    "suede": "Suede", "canvas": "Canvas", "linen": "Linen", "synthetic": "Synthetic",
    "spandex": "Spandex", "velvet": "Velvet",
}
GENDERS = {
    "men's": "Men", "mens": "Men", "man's": "Men", "men": "Men", "women's": "Women",
    "womens": "Women", "woman's": "Women", "women": "Women", "unisex": "Unisex",
    "boy's": "Boys", "boys": "Boys", "girl's": "Girls", "girls": "Girls", "kid's": "Kids",
    "kids": "Kids",
}
STYLES = {
    "running": "Running", "casual": "Casual", "formal": "Formal", "sports": "Sports",
    "athletic": "Athletic", "vintage": "Vintage", "classic": "Classic", "trendy": "Trendy",
    "streetwear": "Streetwear",
}
PATTERNS = {
    "solid": "Solid", "striped": "Striped", "stripe": "Striped", "checked": "Checked",
    "plaid": "Plaid", "floral": "Floral", "polka dot": "Polka Dot", "printed": "Printed",
    "camouflage": "Camouflage", "camo": "Camouflage",
}
SEASONS = {
    "summer": "Summer", "winter": "Winter", "spring": "Spring", "autumn": "Fall",
    "fall": "Fall", "monsoon": "Monsoon", "all-season": "All-Season",
}
OCCASIONS = {
    "party": "Party", "wedding": "Wedding", "office": "Office", "outdoor": "Outdoor",
    "travel": "Travel", "workout": "Workout", "gym": "Gym", "sports": "Sports",
    "casual": "Casual",
}
AGE_GROUPS = {
    "children": "Kids", "child": "Kids", "kids": "Kids", "kid": "Kids", "adult": "Adult",
    "toddler": "Toddler", "infant": "Infant", "baby": "Infant",
}
# Descriptive words that are tags on their own.
DESCRIPTORS = (
    "lightweight", "breathable", "waterproof", "durable", "comfortable", "stylish", "premium",
    "soft", "warm", "stretchable", "washable", "eco-friendly", "sustainable", "quick-dry",
    "anti-slip", "cushioned",
)
# Confidence of a submitted field, of each dictionary and of a descriptor.
SUBMITTED_CONFIDENCE = 1.0
DESCRIPTOR_CONFIDENCE = 0.6
ATTRIBUTE_RULES = (
    ("brand", BRANDS, 0.9),
    ("category", CATEGORIES, 0.85),
    ("color", COLORS, 0.8),
    ("material", MATERIALS, 0.75),
    ("gender", GENDERS, 0.85),
    ("style", STYLES, 0.7),
    ("pattern", PATTERNS, 0.7),
    ("season", SEASONS, 0.7),
    ("occasion", OCCASIONS, 0.65),
    ("age_group", AGE_GROUPS, 0.7),
)
# The attribute fields that count towards completeness.
ATTRIBUTE_FIELDS = (
    "brand", "category", "subcategory", "color", "material", "gender", "style", "pattern",
    "season", "occasion", "age_group",
)


ALL_KEYWORDS = tuple(dict.fromkeys(
    [k for _, dictionary, _ in ATTRIBUTE_RULES for k in dictionary] + list(DESCRIPTORS)))


def _branches(words: list[str]) -> str:
    """The words as one expression that shares common beginnings, longer words first."""
    heads = sorted({w[0] for w in words if w})
    parts = []
    for head in heads:
        tails = [w[1:] for w in words if w and w[0] == head]
        parts.append(re.escape(head) + _branches(tails))
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    if "" not in words:
        return body
    return f"(?:{body})?" if parts else ""


def hit_pattern(keywords) -> str:
    """Matches (without consuming) where a keyword starts; group 1 is the longest one there."""
    return r"(?U)\b(?=(" + _branches(sorted(keywords)) + r")\b)"


def keyword_hits(text: Column, keywords=ALL_KEYWORDS) -> Column:
    """The longest keyword at every place one starts, in text order: one scan for any number
    of dictionaries."""
    return F.regexp_extract_all(F.lower(text), F.lit(hit_pattern(keywords)), F.lit(1))


def _starts_with_word(hit: str, keyword: str) -> bool:
    """Does ``keyword`` match where ``hit`` does: is it the hit or its beginning up to a boundary."""
    if not hit.startswith(keyword):
        return False
    rest = hit[len(keyword):]
    return not rest or not (re.match(r"\w", rest[0]) and re.match(r"\w", keyword[-1]))


def _values_at(dictionary: dict[str, str], keywords) -> dict[str, list[str]]:
    """For every possible hit, the values of the dictionary that match there, in its order."""
    found = {hit: list(dict.fromkeys(v for k, v in dictionary.items() if _starts_with_word(hit, k)))
             for hit in keywords}
    return {hit: values for hit, values in found.items() if values}


def _map(entries: dict) -> Column:
    return F.create_map(*[x for key, value in entries.items() for x in (F.lit(key), value)])


def first_value(hits: Column, dictionary: dict[str, str], keywords=ALL_KEYWORDS) -> Column:
    """Value of the earliest hit, the dictionary's order deciding at the same start."""
    table = _map({h: F.lit(v[0]) for h, v in _values_at(dictionary, keywords).items()})
    known = F.filter(F.transform(hits, lambda h: F.try_element_at(table, h)), lambda v: v.isNotNull())
    return F.try_element_at(known, F.lit(1))


def all_values(hits: Column, dictionary: dict[str, str], keywords=ALL_KEYWORDS) -> Column:
    """Every distinct value with a hit, in dictionary order."""
    table = _map({h: F.array(*map(F.lit, v)) for h, v in _values_at(dictionary, keywords).items()})
    known = F.filter(F.transform(hits, lambda h: F.try_element_at(table, h)), lambda v: v.isNotNull())
    values = F.array(*map(F.lit, dict.fromkeys(dictionary.values())))
    return F.array_intersect(values, F.flatten(known))
