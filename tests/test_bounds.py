"""Groups of packs that the exact neighbor join leaves out, and that it loses nothing by it."""

import numpy as np
import pyarrow as pa
import pytest

from vitrine.operators import neighbors as N


def packs(m, id_name, **carried):
    table = pa.table({id_name: pa.array(range(len(m))), "vector": pa.array(list(m), pa.list_(pa.from_numpy_dtype(m.dtype))),
                      "block": pa.array([0] * len(m), pa.int32()), "others": pa.array([1] * len(m), pa.int32()),
                      "within": pa.array([""] * len(m)),
                      **{c: pa.array(list(v), pa.float64()) for c, v in carried.items()}})
    return [b.slice(i, 1) for b in N._packer([id_name, *carried])(iter(table.to_batches(500))) for i in range(b.num_rows)]


def cell(asked, offered):
    """Rows of one cell as the kernel gets them."""
    schema = {f"{side}_{c}": rows[0].schema.field(c).type for side, rows in (("q", asked), ("p", offered))
              for c in rows[0].schema.names if c not in ("block", "others", "within")}
    for side, rows in (("q", asked), ("p", offered)):
        for row in rows:
            columns = {"within": row["within"], "q_block": pa.array([0]), "p_block": pa.array([0])}
            columns |= {c: row[c[2:]] if c[0] == side else pa.nulls(1, kind) for c, kind in schema.items()}
            yield pa.RecordBatch.from_pydict(columns)


def nearest(q, p, k, **prices):
    asked = packs(q, "query_id", **{c: prices[c] for c in ("min_price", "max_price") if prices})
    offered = packs(p, "product_id", **({"price": prices["price"]} if prices else {}))
    out = list(N._kernel(k, "<f4" if q.dtype == np.float32 else "<f8", bool(prices))(cell(asked, offered)))
    found = {}
    for row in pa.Table.from_batches(out).to_pylist():
        found.setdefault(row["query_id"], []).append((row["product_id"], row["rank_score"]))
    return {i: [j for j, _ in sorted(hits, key=lambda h: (-h[1], h[0]))] for i, hits in found.items()}


def brute(q, p, k, fits=None):
    q, p = (m.astype(float) / np.where((n := np.linalg.norm(m.astype(float), axis=1)) == 0, 1, n)[:, None] for m in (q, p))
    score = np.round(q @ p.T, 9)
    if fits is not None:
        score[~fits] = np.nan
    ranked = {i: [j for j in np.lexsort((np.arange(len(p)), -s)) if not np.isnan(s[j])][:k] for i, s in enumerate(score)}
    return {i: hits for i, hits in ranked.items() if hits}


def titles(n, dims=384, seed=3):
    """Weighted words of short titles: one word each of 40 makers, 30 materials, 20 things and 6 kinds, so that hardly
    one title is there twice."""
    rng = np.random.default_rng(seed)
    m, first = np.zeros((n, dims), np.float32), 0
    for words in (40, 30, 20, 6):
        m[np.arange(n), 3 * (first + rng.integers(0, words, n))] = np.log(words)
        first += words
    return m


def test_groups_that_cannot_give_a_neighbor_are_left_out(monkeypatch):
    m = titles(6000)
    scored = []
    product = np.flatnonzero

    def counted(near):
        if near.ndim == 2:
            scored.append(near.size)
        return product(near)

    monkeypatch.setattr(N.np, "flatnonzero", counted)
    got = nearest(m, m, 5)
    monkeypatch.undo()
    assert got == brute(m, m, 5)
    assert 0 < sum(scored) < 0.25 * len(m) ** 2


def odd(n, dims, seed, dtype):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, dims)) < 0.15, rng.normal(size=(n, dims)), 0).astype(dtype)
    m[rng.random(n) < 0.3] = m[0]
    m[5:9] = 0
    m[11, 3], m[12, 4], m[13] = np.nan, np.inf, 1e-30
    m[14] *= 1e15
    return m[rng.permutation(n)]


@pytest.mark.parametrize("dims", [24, 120])
@pytest.mark.parametrize("dtype", [np.float32, np.float64])
@pytest.mark.parametrize("waiting", [1, 3, 64])
def test_bounds_lose_nothing(monkeypatch, dims, dtype, waiting):
    monkeypatch.setattr(N, "PACK_ROWS", 100)
    monkeypatch.setattr(N, "GROUP_ROWS", 7)
    monkeypatch.setattr(N, "WAITING_PACKS", waiting)
    q, p = odd(700, dims, 1, dtype), odd(1500, dims, 2, dtype)
    assert nearest(q, p, 6) == brute(q, p, 6)
    rng = np.random.default_rng(4)
    price = np.where(rng.random(1500) < 0.1, np.nan, rng.uniform(0, 50, 1500).round())
    low, high = (np.where(rng.random(700) < 0.5, np.nan, rng.uniform(*b, 700).round()) for b in ((0, 30), (20, 60)))
    with np.errstate(invalid="ignore"):
        fits = (np.isnan(low)[:, None] | (price >= low[:, None])) & (np.isnan(high)[:, None] | (price <= high[:, None]))
    assert nearest(q, p, 6, price=price, min_price=low, max_price=high) == brute(q, p, 6, fits)


def test_rows_of_a_pack_are_alike():
    m = titles(3000)
    first = [np.frombuffer(row["matrix"][0].as_py(), np.float32).reshape(-1, m.shape[1]).argmax(axis=1)
             for row in packs(m, "product_id")]
    assert len(first) == 3 and sum(len(set(x)) for x in first) <= 42  # 40 makers, two of them in two packs
