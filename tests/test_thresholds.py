"""Threshold joins lose no pair and leave out most of the others."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vitrine.config import DuplicateConfig
from vitrine.functions.fuzzy import similarity
from vitrine.operators.blocked import _Field, duplicate_pairs, likely_pairs
from vitrine.operators.duplicates import score_pairs
from vitrine.operators.fuzzy_join import candidates, similar_values

WORDS = "red blue trail runner wool shawl denim jacket boots linen shirt eco ñandú a bb ccc 😀".split()


def texts(n, seed):
    rng = random.Random(seed)
    out = {"", "a", "ab", "ba", "aab", "aba", "a" * 40, "a" * 39}
    while len(out) < n:
        t = " ".join(sorted(rng.choice(WORDS) for _ in range(rng.randint(1, 6))))
        if rng.random() < 0.5:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("xyz ") + t[i + rng.randint(0, 2):]
        out.add(t)
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.85, 1.0])
def test_similar_values_equals_all_pairs(spark, threshold):
    values = texts(220, 5)
    df = spark.createDataFrame([(v,) for v in values + values[:20]] + [(None,)], "value string")
    got = {(r["a"], r["b"]): r["similarity"] for r in similar_values(df, threshold).collect()}
    want = {(a, b): similarity(a, b) for i, a in enumerate(values) for b in values[i + 1:]
            if a and similarity(a, b) >= threshold}
    assert got == want


def test_bounds_leave_few_candidates(spark):
    values = texts(400, 6)
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert candidates(df, 0.85).count() < 0.1 * len(values) ** 2 / 2
    assert similar_values(df.limit(0), 0.85).count() == 0
    with pytest.raises(ValueError):
        similar_values(df, 0.0)


def products(spark, n=160, seed=1):
    rng, r = np.random.default_rng(seed), random.Random(seed)
    kinds = ["shoes", "shoe", "shirts", "steel pipe", None]
    brands = ["Acme", "Acme Co", "Zeta", "Omega", None]
    rows, image, text = [], [], []
    for i in range(n):
        old = r.randrange(i) if i and r.random() < 0.4 else None
        if old is not None:  # a near copy
            row = list(rows[old])
            row[0] = i
            for c in (1, 4, 5):
                if r.random() < 0.3:
                    row[c] = (row[c] or "") + r.choice("xyz")
            if r.random() < 0.2:
                row[2] = r.choice(brands)
            rows.append(tuple(row))
            image.append(image[old] + 0.1 * rng.normal(size=6))
            text.append(text[old] + 0.1 * rng.normal(size=4))
        else:
            rows.append((i, f"{r.choice(WORDS)} {r.choice(WORDS)} {i}", r.choice(brands), r.choice(kinds), r.choice(["red", "blue", None]),
                         r.choice(["wool", None]), None, None))
            image.append(rng.normal(size=6))
            text.append(rng.normal(size=4))
    schema = "product_id long, name string, brand string, category string, color string, material string, style string, gender string"
    vec = "product_id long, vector array<double>"
    return (spark.createDataFrame(rows, schema), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(image)], vec),
            spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(text)], vec), image, text)


@pytest.mark.parametrize("threshold,cell_rows", [(0.9, 16_384), (0.9, 7), (0.62, 30)])
def test_duplicate_pairs_equal_all_pairs(spark, threshold, cell_rows):
    catalog, image_df, text_df, image, text = products(spark)
    cfg = DuplicateConfig(threshold=threshold)

    def cosine(m, i, j):
        return float(m[i] @ m[j] / np.linalg.norm(m[i]) / np.linalg.norm(m[j]))

    n = len(image)
    every = spark.createDataFrame([(i, j, cosine(image, i, j), cosine(text, i, j)) for i in range(n) for j in range(i + 1, n)],
                                  "query_id long, product_id long, image_score double, text_score double")
    want = {(r[0], r[1]): round(r.overall_similarity, 8) for r in score_pairs(every, catalog, catalog, cfg).where(
        f"round(overall_similarity, 9) >= {threshold}").collect()}
    got = [(r[0], r[1], round(r.overall_similarity, 8)) for r in duplicate_pairs(
        image_df, text_df, catalog, cfg, cell_rows).collect()]
    assert {(a, b): s for a, b, s in got} == want and len(got) == len(want) > 10
    if threshold == 0.9:
        assert likely_pairs(image_df, text_df, catalog, cfg).count() < 0.1 * n * n / 2


def test_only_duplicates_leave_the_packs(spark):
    catalog, image_df, text_df, _, _ = products(spark)
    cfg = DuplicateConfig(threshold=0.62)
    likely = likely_pairs(image_df, text_df, catalog, cfg, 30)
    assert likely.count() == likely.select("query_id", "product_id").distinct().count()
    found = duplicate_pairs(image_df, text_df, catalog, cfg, 30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Join" not in above and "Aggregate" not in above  # no pair is shuffled


def test_many_values_are_bounded_by_letters_and_few_are_not():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    left, right = pa.array([*words, None, words[0]]), pa.array([None, *reversed(words)])
    many, few = _Field(left, right, {}), _Field(left.slice(0, 9), right.slice(0, 9), {})
    assert few.few and not many.few
    a, b = (x.ravel() for x in np.indices((len(left), len(right))))
    want = np.array([np.nan if left[i].as_py() is None or right[j].as_py() is None else similarity(
        left[i].as_py(), right[j].as_py()) for i, j in zip(a.tolist(), b.tolist())])
    np.testing.assert_array_equal(many.exact(a, b), want)
    x, y = (z.ravel() for z in np.indices((9, 9)))
    np.testing.assert_array_equal(few.all_ratios(x, y), few.exact(x, y))
    there = ~np.isnan(want)
    assert (many.bound(a, b)[there] >= want[there]).all() and np.isnan(many.bound(a, b)[~there]).all()
