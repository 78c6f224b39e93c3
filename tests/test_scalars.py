import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions import fuzzy, keywords as K, scalars as N
from vitrine.operators import enrich as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, key", [
    ("Men shoes", "men-shoes"), (" men-shoes ", "men-shoes"), ("Men  Shoes", "men-shoes"),
    ("MEN SHOES", "men-shoes"), ("men_shoes", "men-shoes"), ("--Men--Shoes--", "men-shoes"),
    ("Nike 90s", "nike-90s"), ("Straße", "strasse"), (None, None), ("", None), ("   ", None),
    ("---", None), ("!!!", None)])
def test_facet_key(spark, value, key):
    assert one(spark, N.facet_key(F.lit(value))) == key
    assert one(spark, N.facet_key(N.facet_key(F.lit(value)))) == key


def test_text_representation(spark):
    def text(*parts):
        return one(spark, N.text_representation(*[F.lit(p) for p in parts]))

    assert text(" Mug ", "Kilnworks", None, "\tred \n") == "Mug. Kilnworks. red"
    assert text("Mug", " ", "", None) == "Mug"
    assert one(spark, N.payload_text(F.lit(7), *[F.lit("")] * 4)) == "7"


def test_small_helpers(spark):
    assert one(spark, N.clamp01(F.lit(1.0000001))) == 1.0
    assert one(spark, N.clamp01(F.lit(-0.2))) == 0.0
    assert one(spark, N.percent(F.lit(0.873))) == "87%"
    assert one(spark, N.positive_price(F.lit("12.5"))) == 12.5
    assert one(spark, N.positive_price(F.lit("n/a"))) is None
    assert one(spark, N.positive_price(F.lit(0.0))) is None
    assert one(spark, N.processed_filename(F.lit("ab.c.png"))) == "ab.c.jpg"
    assert one(spark, N.signed(F.lit(0.09), 4)) == "+0.0900"
    v = one(spark, N.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert v == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize("items, text", [
    ([], "Lead."), (["a"], "Lead: a."), (["a", "b"], "Lead: a and b."),
    (["a", "b", "c"], "Lead: a, b, and c.")])
def test_summary_sentence(spark, items, text):
    column = F.array(*map(F.lit, items)).cast("array<string>")
    assert one(spark, N.summary_sentence("Lead: ", column)) == text


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_fuzzy_matches_plain_definition(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("abc é", k=rng.randint(1, 90))),
              "".join(rng.choices("abc é", k=rng.randint(1, 90)))) for _ in range(300)]
    pairs += [("Nike", "nikee"), ("Running Shoes", "running-shoes"), ("shoes  red", "Red Shoes")]
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", fuzzy.fuzzy_ratio(F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        a, b = (" ".join(sorted(t.lower().split())) for t in (r["a"], r["b"]))
        if not a or not b:
            assert r["x"] is None
        else:
            assert r["x"] == pytest.approx(2 * lcs_length(a, b) / (len(a) + len(b)))
    assert got[-1]["x"] == 1.0
    assert got[-2]["x"] == pytest.approx(0.923, abs=1e-3)


def attributes(spark, name, brand=None, category=None, description=None):
    frame = spark.createDataFrame([(1, name, brand, category, description)],
                                  "product_id long, name string, brand string, category string, "
                                  "description string")
    found = {r["attribute"]: (r["value"], r["confidence"]) for r in E.text_attributes(frame).collect()}
    rows = E.text_tags(frame).orderBy("position").collect()
    return found, [r["tag"] for r in rows]


def test_text_attributes(spark):
    found, tags = attributes(spark, "Nike Air Zoom Pegasus",
                             description="Lightweight breathable red running shoe with mesh upper")
    assert found["brand"] == ("Nike", 0.9)
    assert found["category"] == ("Running Shoes", 0.85)
    assert found["color"] == ("Red", 0.8)
    assert found["material"] == ("Mesh", 0.75)
    assert found["style"] == ("Running", 0.7)
    assert "gender" not in found
    assert {"nike", "red", "mesh", "running", "lightweight", "breathable"} <= set(tags)
    assert len(tags) == len(set(tags))


def test_earliest_keyword_wins(spark):
    assert attributes(spark, "blue and red striped scarf")[0]["color"][0] == "Blue"
    assert "color" not in attributes(spark, "a reddish tint")[0]
    found, tags = attributes(spark, "x", brand="Acme", category="Hats")
    assert found["brand"] == ("Acme", 1.0) and found["category"] == ("Hats", 1.0)
    assert tags[:2] == ["acme", "hats"]
    assert attributes(spark, "women's and men's")[0]["gender"][0] == "Women"
    assert attributes(spark, "étépink")[0] == {}


def plain_first(text, dictionary):
    import re

    best = None
    for keyword, value in dictionary.items():
        m = re.search(rf"\b{re.escape(keyword)}\b", text.lower())
        if m and (best is None or m.start() < best[0]):
            best = (m.start(), value)
    return best and best[1]


def test_one_scan_equals_one_search_per_keyword(spark):
    rng = random.Random(11)
    words = list(K.ALL_KEYWORDS) + ["shoe", "x", "running-shoes", "men's-style", "kid", "'s", "été"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn(
        "h", K.keyword_hits(F.col("t")))
    columns = [K.first_value(F.col("h"), d).alias(a) for a, d, _ in K.ATTRIBUTE_RULES]
    for r in frame.select("t", *columns).collect():
        for attribute, dictionary, _ in K.ATTRIBUTE_RULES:
            assert r[attribute] == plain_first(r["t"], dictionary), (r["t"], attribute)


def test_dictionary_sizes():
    assert len(K.DESCRIPTORS) == 16
    assert len(K.ATTRIBUTE_FIELDS) == 11
