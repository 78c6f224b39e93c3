"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and a rerank with the originals.

A rotation learnt on a bounded sample (SAMPLE vectors) turns the signs of the principal components into balanced
bits (Gong and Lazebnik). ROTATIONS independent rotations give up to 64 bits each, cut into chunks of CHUNK bits;
each chunk is a table. Vectors that agree in one whole chunk meet in its bucket, and their cosine is taken in
double precision from the original vectors. A pair at the threshold misses every table with a chance of about 3 %.

Equal vectors are one class from the start. Buckets are cut into blocks of BLOCK classes that meet in pairs, so no
bucket lies in one task; a task returns link counts and a spanning forest, never the pairs. A pair counts only in
the first table in which it agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vitrine.llm.common import stored
from vitrine.llm.components import components

SAMPLE = 4096
ROTATIONS = 2
CHUNK = 16
STEPS = 30
BLOCK = 1024
COSINE = 0.98


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1, so that no norm over- or underflows.

    The cosines of vectors whose norms did neither are the same to the last bit.
    """
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0, keepdims=True))[1])


def learn(sample: np.ndarray, rotations: int = ROTATIONS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean of the unit vectors and, by rotation, the matrix whose products' signs are the bits."""
    sample = scaled(sample)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(0)
    centred = unit - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, np.argsort(-values)][:, :64]
    projected, out = centred @ axes, []
    for seed in range(rotations):
        rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))
        for _ in range(STEPS):
            u, _, vt = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
            rotation = (u @ vt).T
        out.append(axes @ rotation)
    return mean, out


def chunks(vectors: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """The bits of each chunk of each rotation as one integer: a row per vector, a column per table."""
    vectors = scaled(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - mean
    keys = []
    for rotation in rotations:
        bits = (unit @ rotation >= 0).astype(np.int64)
        for start in range(0, bits.shape[1], CHUNK):
            part = bits[:, start:start + CHUNK]
            keys.append(part @ (1 << np.arange(part.shape[1])))
    return np.stack(keys, 1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of n vertices under the links (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        table, i, j = (group[c][0].as_py() for c in ("table", "i", "j"))
        node, size, block = (group[c].to_numpy() for c in ("node", "n", "block"))
        x, keys = scaled(_matrix(group["vector"])), group["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        norm = np.linalg.norm(x, axis=1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = (x[left] @ x[right].T) / norm[left][:, None] / norm[right] >= cosine
        if i == j:
            found = np.triu(found, 1)
        a, b = np.nonzero(found)
        a, b = left[a], right[b]
        first = (keys[a] == keys[b]).argmax(1) == table
        a, b = a[first], b[first]
        links = np.bincount(a, size[b], len(node)) + np.bincount(b, size[a], len(node))
        root = _forest(len(node), a, b)
        has = np.flatnonzero(links > 0)
        return pa.table({"node": node[has], "links": links[has].astype(np.int64), "root": node[root[has]]})

    return run


def linked_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label).

    Rows of one label and one dimension link at ``cosine`` or more. A vector that is null, zero, empty or holds
    null or non-finite components, and a row with a null label or vec_id, links with nothing: n_links 0, its own
    vec_id as component, kept. Each row counts as a vector, repeated rows too. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) as vector", "label")
    sound = ("vec_id is not null and label is not null and vector is not null and size(vector) > 0 and "
             "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and "
             "exists(vector, x -> x <> 0)")
    sound = F.coalesce(F.expr(sound), F.lit(False))
    good = rows.where(sound)
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("dims", F.size("vector")), "vectors")

    coded = []
    for (dims,) in classes.select("dims").distinct().collect():  # dimensions, not vectors
        own = classes.where(F.col("dims") == dims)
        sample = own.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()["vector"]
        model = learn(_matrix(sample))

        def keys(batches, model=model):
            for batch in batches:
                if batch.num_rows:
                    found = chunks(_matrix(batch.column("vector")), *model)
                    at = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                    codes = pa.ListArray.from_arrays(at, pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, "keys"])

        coded.append(own.mapInArrow(keys, StructType([*own.schema, StructField("keys", ArrayType(LongType()))])))
    if not coded:
        return rows.selectExpr("vec_id", "0L as n_links", "vec_id as component_id", "true as kept")
    coded = stored(_union(coded), "codes")

    bucket = ["label", "dims", "table", "key"]
    placed = coded.select("label", "dims", "node", F.posexplode("keys").alias("table", "key"))
    shared = placed.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1").withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    placed = placed.join(shared, bucket).withColumn("block", F.expr("pmod(hash(node), blocks)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr(
        *bucket, "node", "block", "least(block, other) as i", "greatest(block, other) as j")
    met = placed.join(coded.select("node", "n", "vector", "keys"), "node")
    found = stored(met.groupBy(*bucket, "i", "j").applyInArrow(
        _compare(cosine), "node long, links long, root long"), "links")

    groups = components(found.selectExpr("root as a", "node as b"), "vectors")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    settled = classes.join(links, "node", "left").join(groups, "node", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    linked = good.join(settled, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
