"""All duplicate pairs of a catalog at or above a threshold, found without scoring all pairs and without losing one.

A weighted score bounds each of its parts from below: what the other parts can give at most must leave enough. So

1. facets (brand, category): pairs whose brands and categories are too unlike for the threshold never meet. With a
   threshold of 0.9 one of the two must have a ratio of a half; the facets that may meet come from a threshold join
   over their distinct values. Products without a brand or category may meet all others;
2. vectors: packs of two facets that may meet go through one matrix product, which keeps the pairs whose image and text
   similarity reach what the facets leave to be reached;
3. fields of few different values in the two packs: their ratios are taken once for each pair of values;
4. letters: the letters that the other fields share bound their ratios;
5. what is left is scored exactly.

Packs carry the compared fields with the vectors, so steps 2 to 5 run where two packs meet, and only duplicates leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.config import DEFAULTS, DuplicateConfig
from vitrine.functions.fuzzy import similarity
from vitrine.functions.scalars import rank_value
from vitrine.operators.duplicates import ATTRIBUTE_FIELDS, FUZZY_FIELDS, METADATA_FIELDS
from vitrine.operators.fuzzy_join import similar_values
from vitrine.operators.neighbors import CELL_ROWS, _order, _packer, _unit
from vitrine.operators.pairs import with_tokens
from vitrine.session import materialize

SLACK = 1e-9
#: Pairs of values of a field in two packs up to which all of them are compared.
FEW_VALUES = 4096
#: Compared pairs of values a task remembers, and pairs of products it looks at together.
KNOWN_VALUES, SLICE = 200_000, 1 << 17
SIGNALS = ("image_signal", "text_signal", "metadata_signal", "attribute_signal", "overall_similarity")


def _spare(cfg: DuplicateConfig) -> float:
    """What all parts of a duplicate's score may miss together."""
    return 1 - cfg.threshold


def _least_ratio(cfg: DuplicateConfig) -> float:
    """The ratio that brand or category has in any duplicate: with less in both, the two miss too much."""
    field = cfg.metadata_weight / len(METADATA_FIELDS) + cfg.attribute_weight / len(ATTRIBUTE_FIELDS)
    return 1 - _spare(cfg) / (2 * field)


def _meeting(facets: DataFrame, least: float) -> DataFrame:
    """(f, g), f <= g: the pairs of facets whose brands or categories have a ratio of ``least`` or more.

    ``facets`` has ``facet``, ``brand`` and ``category``, none null.
    """
    pairs = []
    for own in ("brand", "category"):
        value = facets.select("facet", F.col(own).alias("value"))
        near = similar_values(value, least).select("a", "b")
        alike = near.unionByName(near.selectExpr("b as a", "a as b")).unionByName(
            value.selectExpr("value as a", "value as b").distinct())
        pairs.append(value.selectExpr("facet as f", "value as a").join(alike, "a").join(
            value.selectExpr("facet as g", "value as b"), "b").select("f", "g"))
    return pairs[0].unionByName(pairs[1]).where("f <= g").distinct()


class _Field:
    """The values of one field in two packs; ``known`` are the ratios a task has taken so far."""

    def __init__(self, left: pa.Array, right: pa.Array, known: dict):
        self.known, self.codes, self.values = known, [], []
        for side in (left, right):
            coded = side.dictionary_encode()
            self.codes.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
            self.values.append(coded.dictionary.to_pylist())
        self.width = len(self.values[1])
        self.few = len(self.values[0]) * self.width <= FEW_VALUES
        self.counts = self.table = None

    def _at(self, a: np.ndarray, b: np.ndarray, of) -> np.ndarray:
        """``of`` the codes of the pairs that have both values, no number for the others."""
        x, y = self.codes[0][a], self.codes[1][b]
        out = np.full(len(a), np.nan)
        there = (x >= 0) & (y >= 0)
        out[there] = of(x[there], y[there])
        return out

    def all_ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The exact ratios by a table of all pairs of values, whose last row and column are for missing ones."""
        if self.table is None:
            self.table = np.full([len(v) + 1 for v in self.values], np.nan)
            for x in range(len(self.values[0])):
                for y in range(self.width):
                    self.table[x, y] = self._ratio(x, y)
        return self.table[self.codes[0][a], self.codes[1][b]]

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._at(a, b, lambda x, y: np.ones(len(x)))

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.counts is None:
            self.counts = _letters(self.values[0] + self.values[1])
        lengths, first = self.counts.sum(axis=1), len(self.values[0])

        def of(x, y):
            common = [np.minimum(self.counts[x[i:i + 8192]], self.counts[first + y[i:i + 8192]]).sum(axis=1)
                      for i in range(0, len(x), 8192)]
            return 2.0 * np.concatenate([np.zeros(0), *common]) / np.maximum(lengths[x] + lengths[first + y], 1)

        return self._at(a, b, of)

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        def of(x, y):
            code, place = np.unique(x * self.width + y, return_inverse=True)
            return np.array([self._ratio(*divmod(int(c), self.width)) for c in code], dtype=np.float64)[place]

        return self._at(a, b, of)

    def _ratio(self, x: int, y: int) -> float:
        pair = self.values[0][x], self.values[1][y]
        if pair not in self.known:
            if len(self.known) >= KNOWN_VALUES:
                self.known.clear()
            self.known[pair] = similarity(*pair)
        return self.known[pair]


def _letters(values: list[str]) -> np.ndarray:
    """How often each value has each letter."""
    letters = [np.frombuffer(v.encode("utf-32-le"), np.uint32) for v in values]
    kinds, place = np.unique(np.concatenate([np.zeros(0, np.uint32), *letters]), return_inverse=True)
    row = np.repeat(np.arange(len(values)), [len(x) for x in letters])
    return np.bincount(row * len(kinds) + place, minlength=len(values) * len(kinds)).reshape(len(values), -1).astype(np.int32)


def _mean(values: list[np.ndarray]) -> np.ndarray:
    """Mean of what is present, 0 when nothing is."""
    present = sum((~np.isnan(v)).astype(np.int64) for v in values)
    return sum(np.nan_to_num(v) for v in values) / np.maximum(present, 1)


def _near(batches: Iterator[pa.RecordBatch], dtype: str, width: int, cfg: DuplicateConfig):
    """(row, ids, image, text, a, b) of each two packs: the positions of the pairs whose vectors reach ``need``."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {c: batch.column(names.index(c))[i] for c in names}
            ids, sides = {}, {}
            for s in "lr":
                ids[s] = row[f"{s}_product_id"].values
                m = np.frombuffer(row[f"{s}_matrix"].as_py(), dtype).reshape(len(ids[s]), -1)
                sides[s] = _unit(m[:, :width]), _unit(m[:, width:])
            image, text = (sides["l"][k] @ sides["r"][k].T for k in (0, 1))
            sum_ = cfg.image_weight * np.clip(image, 0, 1) + cfg.text_weight * np.clip(text, 0, 1)
            near = sum_ >= row["need"].as_py() - SLACK
            if row["own"].as_py():  # both orders of a pair meet within one block
                order = _order(pa.concat_arrays([ids["l"], ids["r"]]))
                near &= order[:len(ids["l"]), None] < order[None, len(ids["l"]):]
            yield row, ids, image, text, *np.nonzero(near)


def _pairs(dtype: str, width: int, cfg: DuplicateConfig):
    """A ``mapInArrow`` function: the pairs of two packs whose vectors reach ``need``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, image, text, a, b in _near(batches, dtype, width, cfg):
            left, right = ids["l"].take(pa.array(a)), ids["r"].take(pa.array(b))
            yield pa.record_batch([left, right, pa.array(image[a, b]), pa.array(text[a, b])],
                                  names=["query_id", "product_id", "image_score", "text_score"])

    return run


def _duplicates(dtype: str, width: int, cfg: DuplicateConfig):
    """A ``mapInArrow`` function: the pairs of two packs whose score reaches the threshold, with its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], float] = {}
        for row, ids, image, text, all_a, all_b in _near(batches, dtype, width, cfg):
            fields = {f: _Field(row[f"l_tok_{f}"].values, row[f"r_tok_{f}"].values, known) for f in FUZZY_FIELDS}
            many = [f for f, x in fields.items() if not x.few]
            for start in range(0, len(all_a), SLICE):
                a, b = all_a[start:start + SLICE], all_b[start:start + SLICE]
                ratio = {f: x.all_ratios(a, b) for f, x in fields.items() if x.few}
                i, t = np.clip(image[a, b], 0, 1), np.clip(text[a, b], 0, 1)
                # From few values to letters to all values; what cannot reach the threshold goes after each step.
                for step in ("most", "bound", "exact") if many else ("exact",):
                    ratio |= {f: getattr(fields[f], step)(a, b) for f in many}
                    m, r = (_mean([ratio[f] for f in names]) for names in (METADATA_FIELDS, ATTRIBUTE_FIELDS))
                    total = np.clip(cfg.image_weight * i + cfg.text_weight * t + cfg.metadata_weight * m
                                    + cfg.attribute_weight * r, 0, 1)
                    keep = total >= cfg.threshold - 2 * SLACK
                    a, b, i, t, m, r, total = (x[keep] for x in (a, b, i, t, m, r, total))
                    ratio = {f: x[keep] for f, x in ratio.items()}
                yield pa.record_batch(
                    [ids["l"].take(pa.array(a)), ids["r"].take(pa.array(b)), *map(pa.array, (i, t, m, r, total))],
                    names=["query_id", "product_id", *SIGNALS])

    return run


def _found(kernel, image_vectors: DataFrame, text_vectors: DataFrame, products: DataFrame, cfg: DuplicateConfig,
           cell_rows: int, fresh: DataFrame | None, columns: list[str], carried: list[str]) -> DataFrame:
    """What ``kernel`` gives for all packs that may meet: query_id < product_id, then the doubles ``columns``."""
    tokens = with_tokens(products, sorted({"brand", "category", *carried}))
    carried = [f"tok_{c}" for c in carried]
    least = _least_ratio(cfg)
    wild = F.col("tok_brand").isNull() | F.col("tok_category").isNull() | F.lit(least <= 0)
    keyed = tokens.select("product_id", *dict.fromkeys(["tok_brand", "tok_category", *carried]), F.when(wild, "*").otherwise(
        F.concat("tok_brand", F.lit("\x01"), "tok_category")).alias("facet"))
    both = image_vectors.select("product_id", F.col("vector").alias("image")).join(
        text_vectors.select("product_id", F.col("vector").alias("text")), "product_id")
    rows = both.join(keyed, "product_id").withColumn("vector", F.concat("image", "text")).drop("image", "text")
    is_fresh = F.lit(True)
    if fresh is not None:
        rows = rows.join(fresh.select("product_id", F.lit(True).alias("_fresh")), "product_id", "left")
        is_fresh = F.coalesce("_fresh", F.lit(False))
    counts = rows.groupBy("facet").agg(F.count("*").alias("n"), F.min("tok_brand").alias("brand"),
                                       F.min("tok_category").alias("category"))
    # Facets and the pairs of them that meet are small beside the products, and read several times.
    counts = materialize(counts.withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("int")), "facets")
    anything = counts.where("facet = '*'").select(F.col("facet").alias("f"))
    needs = anything.join(counts.select(F.lit("*").alias("f"), F.col("facet").alias("g")), "f")
    if least > 0:
        needs = needs.unionByName(_meeting(counts.where("facet <> '*'").select("facet", "brand", "category"), least))
    needs = needs.withColumn("need", F.lit(cfg.image_weight + cfg.text_weight - _spare(cfg)))
    sizes = counts.select("facet", "blocks")
    needs = materialize(needs.join(sizes.selectExpr("facet as f", "blocks as f_blocks"), "f").join(
        sizes.selectExpr("facet as g", "blocks as g_blocks"), "g"), "meeting")

    element = image_vectors.schema["vector"].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    kind = image_vectors.schema["product_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("others", T.IntegerType()),
        T.StructField("within", T.StringType()), T.StructField("matrix", T.BinaryType()),
        T.StructField("product_id", T.ArrayType(kind)), *(T.StructField(c, T.ArrayType(T.StringType())) for c in carried)])
    dealt = rows.join(sizes, "facet").select(
        "product_id", "vector", *carried, F.concat(F.when(is_fresh, "+").otherwise("-"), "facet").alias("within"),
        F.lit(1).alias("others"), F.expr("cast(pmod(hash(product_id), blocks) as int)").alias("block"))
    packs = dealt.hint("rebalance", "within", "block").mapInArrow(_packer(["product_id", *carried]), schema)

    def side(own: str, first: Column, last: Column, prefix: str, own_block: str, other_block: str) -> DataFrame:
        met = packs.withColumn(own, F.substr("within", F.lit(2))).join(needs, own)
        return met.select(
            "f", "g", "need", F.startswith("within", F.lit("+")).alias(f"{prefix}_fresh"), F.col("block").alias(own_block),
            F.explode(F.sequence(first, last)).alias(other_block),
            *(F.col(c).alias(f"{prefix}_{c}") for c in ("matrix", "product_id", *carried)))

    # Two blocks of one facet meet in one order only.
    same, block = F.col("f") == F.col("g"), F.col("block")
    left = side("f", F.when(same, block).otherwise(F.lit(0)), F.col("g_blocks") - 1, "l", "x", "y")
    right = side("g", F.lit(0), F.when(same, block).otherwise(F.col("f_blocks") - 1), "r", "y", "x").drop("need")
    width = image_vectors.select(F.max(F.size("vector"))).first()[0] or 0
    met = left.join(right, ["f", "g", "x", "y"]).where("l_fresh or r_fresh").withColumn("own", F.expr("f = g and x = y"))
    hits = met.drop("f", "g", "x", "y", "l_fresh", "r_fresh").mapInArrow(kernel(dtype, width, cfg), T.StructType(
        [T.StructField(c, kind) for c in ("query_id", "product_id")] + [T.StructField(c, T.DoubleType()) for c in columns]))
    return hits.where("query_id <> product_id").select(
        F.least("query_id", "product_id").alias("query_id"), F.greatest("query_id", "product_id").alias("product_id"), *columns)


def likely_pairs(image_vectors: DataFrame, text_vectors: DataFrame, products: DataFrame,
                 cfg: DuplicateConfig = DEFAULTS.duplicate, cell_rows: int = CELL_ROWS,
                 fresh: DataFrame | None = None) -> DataFrame:
    """(query_id, product_id, image_score, text_score), query_id < product_id: a superset of all duplicate pairs.

    The vector tables have ``product_id`` and ``vector``; only products with both vectors take part, each once. With
    ``fresh`` (product_id) only pairs with one of these products are wanted: packs of others never meet each other.
    """
    return _found(_pairs, image_vectors, text_vectors, products, cfg, cell_rows, fresh, ["image_score", "text_score"], [])


def duplicate_pairs(image_vectors: DataFrame, text_vectors: DataFrame, products: DataFrame,
                    cfg: DuplicateConfig = DEFAULTS.duplicate, cell_rows: int = CELL_ROWS,
                    fresh: DataFrame | None = None) -> DataFrame:
    """All pairs of products (query_id < product_id) whose weighted similarity is the threshold or more, with its parts.

    With ``fresh`` (product_id) those pairs that one of these products is in.
    """
    found = _found(_duplicates, image_vectors, text_vectors, products, cfg, cell_rows, fresh, list(SIGNALS), FUZZY_FIELDS)
    return found.filter(rank_value(F.col("overall_similarity")) >= cfg.threshold)
