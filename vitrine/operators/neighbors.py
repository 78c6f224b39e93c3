"""Top-k cosine joins between a table of queries and a table of products.

Vectors travel in packs of at most ``PACK_ROWS``. Every key has a grid of its own: its queries and its products are
dealt to blocks of about ``cell_rows`` by a hash of their id, as many as the counted rows of the key ask for, and every
pack meets every pack of the opposite side once, in one cell of the grid. A key with most of the rows is split into
many cells, a small one is a single cell. A cell holds its packs of queries, lets its packs of products pass by, one
matrix product for each pair of packs, and keeps the ``k`` best of each query, so a cell gives ``k`` rows per query; a
window takes the best ``k`` overall. Rows of a pack are like each other (``_likeness``), and of each group of
``GROUP_ROWS`` the largest entries are known: they bound the scores of two groups, so groups that cannot give any of
their queries one of its ``k`` best are left out, and packs that can give the best ones meet first. Blocks of products are ``PRODUCT_CELLS`` times as long as those of queries, so that
few cells give rows for the same query. A pack is copied once for each block of the other side, so beyond
``MOST_BLOCKS`` blocks get longer instead of more: what is moved grows with the table and not with its square, up to
the ``HELD_ROWS`` queries that a task may hold. No pair list is built and the plan is the same for every size of table.

Equality filters are part of the join key: a query that asks for a brand meets the packs of that brand only. A price
range is a mask inside the kernel. ``knn_lsh`` adds the signature of random hyperplanes to the key and so searches the
signatures nearest to the query only (approximate).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.config import SCORE_DECIMALS

PACK_ROWS = 1024
CHUNK_ROWS = 65_536
#: Queries that meet in one cell of a key's grid.
CELL_ROWS = 16_384
#: How many times as many products as queries meet in one cell.
PRODUCT_CELLS = 8
#: Blocks of queries and of products of one key beyond which blocks get longer instead of more.
MOST_BLOCKS = (16, 4)
#: The longest block of queries that a task holds; products only pass by.
HELD_ROWS = 131_072
#: Entries of pairs that are scored one by one; more pairs of two packs are scored as one matrix product.
SINGLE_ENTRIES = 1 << 22
#: Rows of a pack that share one bound.
GROUP_ROWS = 32
#: Largest entries by which the rows of a chunk are put in order, and how many rows are looked at in one go.
LIKENESS, LIKENESS_ROWS = 8, 8192
#: Packs of products, and bytes of them, that wait in a task so that the best can go first.
WAITING_PACKS, WAITING_BYTES = 64, 128 << 20
QUERY_FACETS = ("brand_key", "category_key", "min_price", "max_price")

#: Which equality filters a query sets, as bits: brand 1, category 2.
KEYS = ("brand_key", "category_key")
CellRule = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


# ---------------------------------------------------------------- inside tasks


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _norms(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    norm[norm == 0] = 1.0
    return norm


def _unit(m: np.ndarray) -> np.ndarray:
    return m.astype(np.float64) / _norms(m)[:, None]


def _likeness(m: np.ndarray) -> list[np.ndarray]:
    """Sort keys that bring like vectors together, least important first: the places of the largest entries with their
    signs, the largest entry last."""
    keys = np.full((min(LIKENESS, m.shape[1]), len(m)), -1, np.int32)
    for start in range(0, len(m), LIKENESS_ROWS):
        size = np.abs(m[start:start + LIKENESS_ROWS])
        rows = np.arange(len(size))
        for key in keys:
            place = size.argmax(axis=1)
            filled = size[rows, place] > 0
            key[start:start + len(size)] = np.where(filled, 2 * place + (m[start + rows, place] < 0), -1)
            size[rows, place] = 0
    return list(keys[::-1])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _packer(carried: list[str]):
    """A ``mapInArrow`` function that turns rows into packs of one block and key each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            raw = _matrix(table.column("vector"))
            block = table.column("block").to_numpy()
            within = table.column("within").combine_chunks().dictionary_encode()
            if isinstance(within, pa.ChunkedArray):
                within = within.chunk(0)
            codes = within.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((*_likeness(raw), codes, block))
            block, codes = block[order], codes[order]
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(codes) != 0)) + 1
            starts = np.concatenate(([0], change))
            ends = np.concatenate((change, [len(order)]))
            bounds = [
                (s, min(s + PACK_ROWS, e))
                for first, e in zip(starts, ends)
                for s in range(first, e, PACK_ROWS)
            ]
            offsets = pa.array([s for s, _ in bounds] + [len(order)], pa.int32())
            heads = [s for s, _ in bounds]
            arrays = [
                pa.array(block[heads].astype(np.int32)),
                table.column("others").combine_chunks().take(pa.array(order[heads])),
                within.dictionary.take(pa.array(codes[heads])),
                pa.array([raw[order[s:e]].tobytes() for s, e in bounds], pa.binary()),
            ]
            arrays += [
                pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks().take(pa.array(order)))
                for c in carried
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "others", "within", "matrix", *carried])

    return run


def _assigner(rule: CellRule):
    """A ``mapInArrow`` function that adds ``cell``, repeating a row for each of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            rows, cells = rule(_matrix(table.column("vector")))
            for start in range(0, len(rows), CHUNK_ROWS):
                part = slice(start, start + CHUNK_ROWS)
                out = table.take(pa.array(rows[part])).append_column(
                    "cell", pa.array(cells[part].astype(np.int32)))
                yield from out.combine_chunks().to_batches()

    return run


def hyperplanes(tables: int, bits: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dims))


def _signatures(tables: int, bits: int, seed: int, probes: int = 1) -> CellRule:
    """The ``probes`` cells of each hash table nearest to a vector.

    A vector's own cell is its sign pattern against the table's planes; another cell is as far as the squared distances
    to the planes that lie between add up to.
    """
    weights = 1 << np.arange(bits)
    masks = np.arange(1 << bits)
    crossed = (masks[:, None] >> np.arange(bits) & 1).astype(np.float64)

    def rule(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        planes = hyperplanes(tables, bits, raw.shape[1], seed)
        rows, cells = [], []
        for t in range(tables):
            margin = raw.astype(np.float64) @ planes[t].T
            own = (margin > 0) @ weights
            if probes == 1:
                near = np.zeros((len(raw), 1), np.int64)
            else:
                away = np.round(margin ** 2 @ crossed.T, SCORE_DECIMALS)
                near = np.argsort(away, axis=1, kind="stable")[:, :probes]
            cells.append(((own[:, None] ^ masks[near]) + t * (1 << bits)).ravel())
            rows.append(np.repeat(np.arange(len(raw)), near.shape[1]))
        return np.concatenate(rows), np.concatenate(cells)

    return rule


def _floats(values: pa.Array) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values.to_pylist()], dtype=np.float64)


def _allowed(price: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which prices lie in the range of a query; a missing price lies in none."""
    with np.errstate(invalid="ignore"):
        return (np.isnan(low) | (price >= low)) & (np.isnan(high) | (price <= high))


def _best(score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best per row, score descending and then ``order`` ascending."""
    width = score.shape[1]
    if width > k:
        kth = np.partition(score, width - k, axis=1)[:, width - k]
        rows, cols = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
    else:
        rows, cols = np.nonzero(score > -np.inf)
    ranked = np.lexsort((order[cols], -score[rows, cols], rows))
    rows, cols = rows[ranked], cols[ranked]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def _part(m: np.ndarray, rows: np.ndarray, dims: np.ndarray | slice) -> np.ndarray:
    """Different rows and some dimensions of a matrix, which is not copied if these are all."""
    m = m if len(rows) == len(m) else m[rows]
    return m[:, dims]


class _Pack:
    """Vectors of a pack in the dimensions in which one of them is not 0, and bounds of its groups of rows."""

    def __init__(self, ids: pa.Array, matrix: bytes, dtype: str):
        self.ids = ids.take(pa.array(np.arange(len(ids))))  # a copy: its batch is not held
        raw = np.frombuffer(matrix, dtype).reshape(len(ids), -1)
        self.width = raw.shape[1]
        self.norm = _norms(raw)
        odd = ~np.isfinite(raw).all(axis=1)
        self.norm[odd] = np.nan  # such a vector has no scores, whichever dimensions count
        rough = (raw / self.norm[:, None]).astype(np.float32)
        starts = np.arange(0, len(ids), GROUP_ROWS)
        sides = [np.maximum.reduceat(np.maximum(side, 0), starts) for side in (rough, -rough)]
        self.reach = np.hstack(sides)
        used = rough.any(axis=0)
        if odd.any() or 2 * used.sum() > self.width:
            used[:] = True
        used[:1] = True
        self.used, self.dims = used, np.flatnonzero(used)
        self.highest, self.lowest = (side[:, self.dims] for side in sides)
        self.signed = bool(np.isnan(self.lowest).any() or self.lowest.any())
        narrow = not used.all()
        self.raw, self.rough = (raw[:, self.dims], rough[:, self.dims]) if narrow else (raw, rough)

    def shared(self, other: _Pack) -> np.ndarray | slice:
        """Which of ``dims`` count in products with the other pack."""
        both = other.used[self.dims]
        return slice(None) if both.all() else np.flatnonzero(both)

    def unit(self, rows: np.ndarray, dims: np.ndarray | slice) -> np.ndarray:
        return self.raw[rows][:, dims] / self.norm[rows, None]

    def members(self, groups: np.ndarray) -> np.ndarray:
        """Rows of some groups."""
        return np.flatnonzero(np.repeat(groups, GROUP_ROWS)[:len(self.norm)])


class _Offered(_Pack):
    """A pack of products that all packs of queries of its cell meet."""

    def __init__(self, row: dict, dtype: str, priced: bool):
        super().__init__(row["p_product_id"], row["p_matrix"], dtype)
        self.order = _order(self.ids)
        self.price = _floats(row["p_price"]) if priced else None


class _Held(_Pack):
    """A pack of queries with the ``k`` best products of each among the packs it has met."""

    def __init__(self, row: dict, k: int, dtype: str, priced: bool):
        super().__init__(row["q_query_id"], row["q_matrix"], dtype)
        self.k = k
        # What single precision can be off by: each entry, product and sum, and the limit itself.
        self.slack = (self.width + 8) * 2.0 ** -23 + 10.0 ** -SCORE_DECIMALS
        # Bounds add up entries that are not negative, so there it is a share of them.
        self.share = np.float32(1 + (2 * self.width + 8) * 2.0 ** -23)
        self.range = tuple(_floats(row[f"q_{c}"]) for c in ("min_price", "max_price")) if priced else None
        self.limit, self.least, self.best, self.pending, self.waiting = None, None, None, [], 0

    def meet_all(self, offered: list[_Offered], reach: np.ndarray, starts: np.ndarray) -> None:
        """Meets packs in the order of the best that they can give, and none that cannot give anything.

        ``reach`` has the bounds of all their groups, ``starts`` where those of each begin.
        """
        bound = self.reach @ reach.T * self.share
        best = np.maximum.reduceat(bound.max(axis=0), starts)
        best[np.isnan(best)] = np.inf
        ends = np.append(starts[1:], len(reach))
        for i in np.argsort(-best, kind="stable"):
            if self.least is None:
                self.meet(offered[i], np.ones(len(self.reach), bool), np.ones(ends[i] - starts[i], bool))
                continue
            if best[i] < self.least.min():
                break
            alive = ~(bound[:, starts[i]:ends[i]] < self.least[:, None])
            groups = alive.any(axis=1)
            if groups.any():
                self.meet(offered[i], groups, alive.any(axis=0))

    def meet(self, p: _Offered, asking: np.ndarray, giving: np.ndarray) -> None:
        """Meets some groups of a pack with some of its own."""
        mine, theirs = self.shared(p), p.shared(self)
        rows, r = self.members(asking), None
        if self.limit is not None:
            rough = _part(self.rough, rows, mine)
            if self.signed:
                bound = np.maximum(rough, 0) @ p.highest[giving][:, theirs].T
                bound += np.maximum(-rough, 0) @ p.lowest[giving][:, theirs].T
            else:
                bound = rough @ p.highest[giving][:, theirs].T
            alive = ~(bound * self.share < self.limit[rows, None])
            some = alive.any(axis=1)
            rows, rough = rows[some], _part(rough, np.flatnonzero(some), slice(None))
            giving = giving.copy()
            giving[giving] = alive.any(axis=0)
            if not len(rows):
                return
        cols = p.members(giving)
        if self.limit is not None:
            near = rough @ _part(p.rough, cols, theirs).T
            r, c = np.divmod(np.flatnonzero(near >= self.limit[rows, None]), len(cols))
        if r is None or len(r) * min(len(self.dims), len(p.dims)) > SINGLE_ENTRIES:
            raw = self.unit(rows, mine) @ p.unit(cols, theirs).T
            score = np.round(raw, SCORE_DECIMALS)
            if self.range:
                score[~_allowed(p.price[None, cols], *(x[rows, None] for x in self.range))] = -np.inf
            score[np.isnan(score)] = -np.inf
            r, c = _best(score, p.order[cols], self.k)
            raw, score = raw[r, c], score[r, c]
            r, c = rows[r], cols[c]
        else:
            r, c = rows[r], cols[c]
            raw = np.einsum("ij,ij->i", self.unit(r, mine), p.unit(c, theirs))
            score = np.round(raw, SCORE_DECIMALS)
            if self.range:
                fit = _allowed(p.price[c], *(x[r] for x in self.range))
                r, c, raw, score = r[fit], c[fit], raw[fit], score[fit]
        self.pending.append((r, p.ids.take(pa.array(c)), raw, score))
        self.waiting += len(r)
        if self.best is None or 2 * self.waiting > len(self.best[0]):
            self._merge()

    def _merge(self) -> None:
        parts = ([self.best] if self.best else []) + self.pending
        rows, raw, score = (np.concatenate([x[c] for x in parts]) for c in (0, 2, 3))
        ids = pa.concat_arrays([x[1] for x in parts])
        ranked = np.lexsort((_order(ids), -score, rows))
        sorted_rows = rows[ranked]
        place = np.arange(len(ranked)) - np.searchsorted(sorted_rows, sorted_rows)
        keep = ranked[place < self.k]
        self.best, self.pending, self.waiting = (rows[keep], ids.take(pa.array(keep)), raw[keep], score[keep]), [], 0
        limit = np.full(len(self.norm), -np.inf)
        last = ranked[place == self.k - 1]
        limit[rows[last]] = score[last] - self.slack
        self.limit = limit.astype(np.float32)
        self.least = np.minimum.reduceat(limit, np.arange(0, len(limit), GROUP_ROWS))

    def hits(self) -> pa.RecordBatch:
        if self.pending:
            self._merge()
        rows, ids, raw, score = self.best
        return pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array(rows)), ids, pa.array(raw), pa.array(score)],
            names=["query_id", "product_id", "score", "rank_score"])


def _order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids."""
    values = ids.to_numpy(zero_copy_only=False)
    return values if values.dtype.kind in "iu" else np.unique(values, return_inverse=True)[1]


def _kernel(k: int, dtype: str, priced: bool):
    """A ``mapInArrow`` function: the ``k`` best of each query of a cell among the packs of products that follow.

    Cells of one block of queries that come one after the other are one cell.
    """

    def meet(held: list[_Held], offered: list[_Offered]) -> None:
        if held and offered:
            starts = np.cumsum([0] + [len(p.reach) for p in offered[:-1]])
            reach = np.vstack([p.reach for p in offered])
            for pack in held:
                pack.meet_all(offered, reach, starts)
        offered.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, held, offered, size = None, None, [], [], 0
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(names)}
                row = {c: v.values if isinstance(v, pa.ListScalar) else v.as_py() for c, v in row.items()}
                here = row["within"], row["q_block"]
                if here != block:
                    meet(held, offered)
                    yield from (pack.hits() for pack in held if pack.best)
                    block, first, held, size = here, row["p_block"], [], 0
                if row["q_matrix"] is not None:
                    if row["p_block"] == first:
                        held.append(_Held(row, k, dtype, priced))
                elif held:
                    offered.append(_Offered(row, dtype, priced))
                    size += offered[-1].raw.nbytes + offered[-1].rough.nbytes
                    if len(offered) == WAITING_PACKS or size >= WAITING_BYTES:
                        meet(held, offered)
                        size = 0
        meet(held, offered)
        yield from (pack.hits() for pack in held if pack.best)

    return run


# ---------------------------------------------------------------- on the plan


def top_k(hits: DataFrame, k: int, *, by: str = "rank_score", group: str = "query_id",
          tie: str = "product_id") -> DataFrame:
    """The ``k`` best rows per group with their rank; Spark limits each group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(tie).asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rows(df: DataFrame, id_name: str, facets: list[str], within: str | None) -> DataFrame:
    columns = [F.col(id_name), F.col("vector")]
    columns += [F.col(f).cast("double") if "price" in f else F.col(f) for f in facets]
    columns.append(F.col(within).cast("string").alias("within") if within else F.lit("").alias("within"))
    return df.select(*columns).filter(F.col("vector").isNotNull() & F.col("within").isNotNull())


def _keyed(queries: DataFrame, products: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds to ``within`` the equality filters a query sets; products carry one row for each set of filters."""
    if not keys:
        return queries, products

    def key(names: tuple[str, ...]):
        return F.to_json(F.struct(F.col("within"), *(F.col(n) for n in names)))

    sets = [tuple(k for i, k in enumerate(keys) if bits >> i & 1) for bits in range(1 << len(keys))]
    own = F.coalesce(*(F.when(sum(F.col(k).isNotNull().cast("int") * (1 << i) for i, k in enumerate(keys)) == bits,
                              key(names)) for bits, names in enumerate(sets)))
    offered = F.array_compact(F.array(*(
        F.when(reduce(Column.__and__, (F.col(n).isNotNull() for n in names), F.lit(True)), key(names)) for names in sets)))
    return (queries.withColumn("within", own).drop(*keys),
            products.withColumn("within", F.explode(offered)).drop(*keys))


def _grid(asked: DataFrame, offered: DataFrame, cell_rows: int, product_rows: int | None = None,
          most: tuple[int, int] | None = None) -> DataFrame:
    """(within, q_blocks, p_blocks) of the keys that need more than one cell, from the numbers of their rows.

    Few keys do: at most the number of rows over ``cell_rows``. Products come in blocks of ``product_rows``, if given.
    More blocks than ``most``, if given, are only as many as keep ``HELD_ROWS`` queries in one.
    """
    def blocks(df: DataFrame, name: str, rows: int, limit: Column | None) -> DataFrame:
        needed = F.ceil(F.count("*") / rows)
        return df.groupBy("within").agg((needed if limit is None else F.least(needed, limit)).cast("int").alias(name))

    held = F.greatest(F.lit(most[0]), F.ceil(F.count("*") / HELD_ROWS)) if most else None
    both = blocks(asked, "q_blocks", cell_rows, held).join(
        blocks(offered, "p_blocks", product_rows or cell_rows, F.lit(most[1]) if most else None), "within")
    return both.where("q_blocks > 1 or p_blocks > 1")


def _packs(df: DataFrame, grid: DataFrame, id_name: str, carried: list[str], prefix: str, other: str) -> DataFrame:
    """Packs of the rows of one key and block, which are brought together first so that packs fill up and are coherent,
    once for each block of the other side."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("others", T.IntegerType()),
         T.StructField("within", T.StringType()), T.StructField("matrix", T.BinaryType())]
        + [T.StructField(c, T.ArrayType(kinds[c])) for c in carried])
    sized = df.join(grid, "within", "left").withColumns({
        "block": F.expr(f"cast(pmod(hash({id_name}), coalesce({prefix}_blocks, 1)) as int)"),
        "others": F.coalesce(F.col(f"{other}_blocks"), F.lit(1))}).drop("q_blocks", "p_blocks")
    together = sized.hint("rebalance", "within", "block").sortWithinPartitions("within", "block")
    packs = together.mapInArrow(_packer(carried), schema)
    return packs.select("within", F.col("block").alias(f"{prefix}_block"),
                        F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(f"{other}_block"),
                        *[F.col(c).alias(f"{prefix}_{c}") for c in ("matrix", *carried)])


def _scored(queries: DataFrame, products: DataFrame, k: int, cell_rows: int, prices: bool) -> DataFrame:
    """The ``k`` best products of each query and cell with equal ``within``."""
    element = products.schema["vector"].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("product_id", products.schema["product_id"].dataType),
        T.StructField("score", T.DoubleType()), T.StructField("rank_score", T.DoubleType())])
    grid = _grid(queries, products, cell_rows, PRODUCT_CELLS * cell_rows, MOST_BLOCKS)
    asked = _packs(queries, grid, "query_id", ["query_id", *(("min_price", "max_price") if prices else ())], "q", "p")
    offered = _packs(products, grid, "product_id", ["product_id", *(("price",) if prices else ())], "p", "q")
    # Of each cell the queries come first; each pack is handed over once for each of its cells.
    cells = asked.unionByName(offered, allowMissingColumns=True).repartition("within", "q_block", "p_block")
    ordered = cells.sortWithinPartitions("within", "q_block", "p_block", F.col("q_matrix").isNull())
    return ordered.mapInArrow(_kernel(k, dtype, prices), schema)


def _sides(queries: DataFrame, products: DataFrame, within: str | None) -> tuple[DataFrame, DataFrame, bool]:
    keys = [c for c in KEYS if c in queries.columns and c in products.columns]
    bounds = [c for c in ("min_price", "max_price") if c in queries.columns]
    prices = bool(bounds) and "price" in products.columns
    for bound in ("min_price", "max_price"):
        if prices and bound not in bounds:
            queries = queries.withColumn(bound, F.lit(None).cast("double"))
    asked = _rows(queries, "query_id", keys + (["min_price", "max_price"] if prices else []), within)
    offered = _rows(products, "product_id", keys + (["price"] if prices else []), within)
    return *_keyed(asked, offered, keys), prices


def knn_join(queries: DataFrame, products: DataFrame, k: int, *, within: str | None = None,
             exclude_self: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The exact ``k`` most similar products per query: (query_id, product_id, score, rank).

    ``queries`` has ``query_id`` and ``vector``, and optionally the filters ``brand_key``, ``category_key``,
    ``min_price``, ``max_price`` (a null filters nothing); ``products`` has ``product_id``, ``vector`` and the
    facets ``brand_key``, ``category_key``, ``price`` those filters refer to. Filters apply before the top-k.
    ``within`` names a column that must be equal on both sides. Ties go to the lower product id. ``cell_rows`` is
    the number of queries that meet ``PRODUCT_CELLS`` times as many products in one task, until a key has ``MOST_BLOCKS``
    blocks; the result does not depend on it.
    """
    asked, offered, prices = _sides(queries, products, within)
    depth = k + 1 if exclude_self else k
    best = top_k(_scored(asked, offered, depth, cell_rows, prices), depth)
    if exclude_self:
        best = top_k(best.filter(F.col("query_id") != F.col("product_id")).drop("rank"), k)
    return best.select("query_id", "product_id", "score", "rank")


def knn_lsh(queries: DataFrame, products: DataFrame, k: int, *, tables: int, bits: int, seed: int = 7, probes: int = 1,
            within: str | None = None, exclude_self: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Approximate ``knn_join``: of each of ``tables`` hash tables a query sees the ``probes`` cells nearest to it.

    A cell is a signature of ``bits`` bits: more bits mean less work and lower recall; more tables the opposite, at the
    cost of more copies of the products, and more probes the opposite at the cost of more copies of the queries only.
    Scores are exact; a product whose cell is probed in no table is missed.
    """
    asked, offered, prices = _sides(queries, products, within)
    depth = k + 1 if exclude_self else k

    def signed(df: DataFrame, rule: CellRule) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
        return df.mapInArrow(_assigner(rule), schema).withColumn(
            "within", F.concat_ws("/", F.col("cell").cast("string"), "within")).drop("cell")

    own, near = _signatures(tables, bits, seed), _signatures(tables, bits, seed, probes)
    hits = _scored(signed(asked, near), signed(offered, own), depth, cell_rows, prices)
    # A pair found in several tables is one hit.
    distinct = hits.groupBy("query_id", "product_id").agg(
        F.max("score").alias("score"), F.max("rank_score").alias("rank_score"))
    if exclude_self:
        distinct = distinct.filter(F.col("query_id") != F.col("product_id"))
    return top_k(distinct, k).select("query_id", "product_id", "score", "rank")
