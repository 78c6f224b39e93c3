"""Near-duplicate documents by HyperMinHash over word shingles, with every link confirmed on full shingle sets.

Each document keeps REGISTERS registers. A register is the minimum of one hash function over the shingles, stored
as its count of leading zeros (6 bits) and the 10 mantissa bits after the leading one. Four registers side by side
are a 64-bit band. Documents with an equal set of shingles are one class from the start.

1. Classes that share a band are candidates. First each is held against the smallest class of each of its bands.
2. The estimate (share of equal registers, corrected for the collisions that two independent sets of those sizes
   would have) drops pairs far below the threshold before any text moves.
3. What is left is confirmed on the whole texts: the exact sets of shingles.
4. Bands whose classes do not yet lie in one component are compared in full, in blocks of about BLOCK shingles:
   estimates first, then the exact sets, best estimates first. Pairs inside a component are never needed: they
   cannot change it. A block returns the links that join components, never its pairs.

With bands of four registers and 28 bands, a pair at Jaccard 0.75 shares no band with a chance of 2.4e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import MIX_A, MIX_B, MIX_C, Runs, fingerprints, mixed, slices, stored, words
from vitrine.llm.components import components

SHINGLE = 5
BANDS = 28
PER_BAND = 4
REGISTERS = BANDS * PER_BAND
MANTISSA = 10
#: Similarity as a fraction: 100 * intersection >= 75 * union.
SHARE, OF = 75, 100
#: Pairs whose estimate is this far below the threshold are not confirmed: four standard deviations.
MARGIN = 0.165
#: Shingles of the classes of one band that meet others in one task.
BLOCK = 1 << 20
#: Shingles hashed at a time, so that the numbers stay in the processor's cache.
CACHED = 1 << 15


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the texts' shingles, with repeats, and each text's first one (one more at the end)."""
    codes, offsets, distinct = words(pc.ascii_lower(pc.fill_null(texts, "")))
    runs = Runs(fingerprints(distinct)[codes])
    count = np.diff(offsets)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    start = np.repeat(offsets[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
    return runs.of(start, start + np.repeat(np.minimum(count, size), made)), bounds


def registers(prints: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of registers for each text that has a shingle."""
    rng = np.random.default_rng(20)
    scale = rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64)
    firsts = bounds[:-1][bounds[1:] > bounds[:-1]]
    least = np.empty((REGISTERS, len(firsts)), np.uint64)
    ends, begin = np.append(firsts[1:], bounds[-1]), 0
    while begin < len(firsts):
        end = max(begin + 1, int(np.searchsorted(ends, firsts[begin] + CACHED, side="right")))
        x, at = prints[firsts[begin]:ends[end - 1]], firsts[begin:end] - firsts[begin]
        work = np.empty_like(x)
        for r in range(REGISTERS):
            np.multiply(x, scale[r], out=work)
            np.add(work, shift[r], out=work)
            least[r, begin:end] = np.minimum.reduceat(work, at)
        begin = end
    bits = least.T.astype(np.float64).view(np.uint64)
    zeros = np.clip(1023 + 63 - (bits >> np.uint64(52)).astype(np.int64), 0, 63)
    mantissa = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype("<u2")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        prints, bounds = shingles(part.column("text"))
        count, one, two = (np.zeros(part.num_rows, np.int64) for _ in range(3))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                own = np.unique(prints[a:b])
                count[i] = len(own)
                one[i] = mixed(own).sum().view(np.int64)
                two[i] = mixed(own ^ np.uint64(MIX_C)).sum().view(np.int64)
        full = count > 0
        keys = np.ascontiguousarray(registers(prints, bounds)).view("<i8")
        at = np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)
        yield pa.record_batch([part.column("doc_id"), pa.array(count), pa.array(one), pa.array(two),
                               pa.ListArray.from_arrays(at, pa.array(keys.ravel()))],
                              names=["doc_id", "n_shingles", "set_one", "set_two", "bands"])


def expected_collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that one register of two independent sets of these sizes is equal."""
    high = 2.0 ** -np.arange(0, 63)
    low = high / 2

    def mass(n):
        n = np.asarray(n, np.float64)[:, None]
        return np.exp(n * np.log1p(-low)) - np.where(high < 1, np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-16))), 0)

    return (mass(a) * mass(b)).sum(1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, without the collisions to be expected."""
    chance = expected_collisions(a, b)
    return (equal / REGISTERS - chance) / (1 - chance)


def _lanes(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, BANDS).view("<u2")


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            equal = (_lanes(batch.column("bands_a")) == _lanes(batch.column("bands_b"))).sum(1)
            sizes = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = pa.array(estimate(equal, *sizes) >= SHARE / OF - MARGIN)
            yield batch.select(["a", "b"]).filter(keep)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sides = [shingles(part.column(c)) for c in ("text_a", "text_b")]
            linked = []
            for i in range(part.num_rows):
                x, y = (np.unique(p[b[i]:b[i + 1]]) for p, b in sides)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(OF * common >= SHARE * (len(x) + len(y) - common) and common > 0)
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _across(group: pa.Table) -> pa.Table:
    """Links between different components of one block and another, as many as join what can be joined."""
    group = group.combine_chunks()
    band, i, j = (group[c][0].as_py() for c in ("band", "i", "j"))
    block = group["block"].to_numpy()
    left, right = (np.flatnonzero(block == x) for x in (i, j))
    node, size = group["node"].to_numpy(), group["n"].to_numpy()
    root, part = np.unique(group["component"].to_numpy(), return_inverse=True)
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    lanes = bands.view("<u2")
    prints, bounds = shingles(group["text"].combine_chunks())
    sets: dict[int, np.ndarray] = {}

    def full(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = np.unique(prints[bounds[x]:bounds[x + 1]])
        return sets[x]

    a, b = [], []
    for x in left:
        y = right[part[right] != part[x]]
        y = y[node[y] > node[x]] if i == j else y
        y = y[(SHARE * np.maximum(size[y], size[x]) <= OF * np.minimum(size[y], size[x]))]
        # A pair belongs to the first band that it shares.
        y = y[(bands[y] == bands[x]).argmax(1) == band]
        if not len(y):
            continue
        score = estimate((lanes[y] == lanes[x]).sum(1), np.full(len(y), size[x]), size[y])
        order = np.argsort(-score, kind="stable")
        for z in y[order[score[order] >= SHARE / OF - MARGIN]]:
            if part[z] == part[x]:
                continue
            common = len(np.intersect1d(full(x), full(z), assume_unique=True))
            if OF * common >= SHARE * (len(full(x)) + len(full(z)) - common):
                a.append(min(node[x], node[z]))
                b.append(max(node[x], node[z]))
                part[part == part[z]] = part[x]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _with_sides(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    A text's set is its distinct shingles of five words (ASCII letters lower-cased), or the whole sequence as one if
    it has fewer words; a null text, or one without words, has an empty set and is linked with nothing. Links have
    100 * intersection >= 75 * union. Rows that share a doc_id are one document; a row with a null doc_id is linked
    with nothing, its component is null and it is kept. An empty table gives an empty result.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sketches = stored(rows.mapInArrow(
        _sketch, "doc_id long, n_shingles long, set_one long, set_two long, bands array<long>"), "sketches")
    same = ["set_one", "set_two", "n_shingles"]
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy(*same).agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")),
                     "classes")
    nodes = classes.selectExpr("node", "n_shingles as n", "bands")
    # Rows of one doc_id with different texts are different classes; they are linked from the start.
    own = full.join(classes.drop("bands"), same).where("node <> doc_id").selectExpr(
        "node as a", "doc_id as b").distinct()
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    members = stored(members.join(shared, ["band", "key"]).select("band", "key", "node", "a"), "members")

    pairs = members.where("a <> node").selectExpr("a", "node as b").distinct()
    promising = stored(_with_sides(pairs, nodes, "n", "bands").select(
        "a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(_promising, "a long, b long"), "pairs")
    ids = members.select(F.col("node").alias("doc_id")).distinct()
    texts = stored(rows.join(ids, "doc_id", "left_semi").selectExpr("doc_id as node", "text").distinct(), "texts")

    def confirmed(candidates: DataFrame) -> DataFrame:
        both = _with_sides(candidates, texts, "text").select("a", "b", "text_a", "text_b")
        return stored(both.mapInArrow(_confirm, "a long, b long").distinct(), "links")

    links = own.unionByName(confirmed(promising))
    groups = stored(components(links, "near"), "groups")
    marked = members.drop("a").join(groups, "node", "left").join(nodes.select("node", "n"), "node").withColumn(
        "component", F.coalesce("component", "node"))
    mixed_bands = marked.groupBy("band", "key").agg(
        F.count("*").alias("size"), F.sum("n").alias("total"), F.min("component").alias("low"),
        F.max("component").alias("high")).where("low < high and size > 2").selectExpr(
        "band", "key", f"cast(ceil(total / {BLOCK}) as int) as blocks")
    met = marked.join(mixed_bands, ["band", "key"]).withColumn("block", F.expr("pmod(hash(node), blocks)"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr(
        "band", "key", "node", "component", "block", "least(block, other) as i", "greatest(block, other) as j")
    found = stored(met.join(nodes, "node").join(texts, "node").groupBy("band", "key", "i", "j").applyInArrow(
        _across, "a long, b long"), "links")
    groups = stored(components(links.unionByName(found), "near"), "groups")

    settled = classes.drop("bands").join(groups, "node", "left").select(
        *same, F.coalesce("component", "node").alias("component_id"))
    out = sketches.select("doc_id", *same).join(settled, same, "left")
    empty = F.col("n_shingles") == 0
    component = F.when(empty | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
