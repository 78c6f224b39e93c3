"""Exact top-k search by inner product with vector-approximation files.

Every component is quantised to one of CELLS intervals between the dimension's smallest and largest value, and the
approximation file holds a vector as these cell numbers, a byte each. From the cells alone follow a lower and an
upper bound of every inner product.

1. Packs of queries meet packs of cell numbers. A pack of queries keeps, for each query, the rows whose upper bound
   reaches the k-th best lower bound of the pack.
2. The k-th best lower bound over all packs drops what cannot be in the result.
3. The exact vectors of the k rows with the best upper bounds are read first; their k-th best score is what a
   further row must reach. Then only rows whose upper bound does are read. The result is then certain.

Equal vectors are one row with its k + 1 smallest ids: no more of them can be among any k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import stored

CELLS = 64
#: Rows of a pack, and queries of a pack.
PACK = 4096
ASKED = 512


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _bounds(k: int, low: np.ndarray, step: np.ndarray):
    """Of one pack of queries and one of cells: candidates with their bounds."""

    def run(group: pa.Table) -> pa.Table:
        asked = np.asarray(group["asked"])
        query = group.filter(pa.array(asked))
        other = group.filter(pa.array(~asked))
        if not query.num_rows or not other.num_rows:
            return pa.table({c: np.empty(0, t) for c, t in (("query", "i8"), ("node", "i8"), ("least", "f8"), ("most", "f8"))})
        q, node = _matrix(query["vector"]), other["node"].to_numpy()
        cells = np.frombuffer(b"".join(other["cells"].to_pylist()), np.uint8).reshape(len(node), -1)
        floor = low + cells * step
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        ceiling = floor + step
        least, most = up @ floor.T + down @ ceiling.T, up @ ceiling.T + down @ floor.T
        slack = 1e-9 * (np.abs(least) + np.abs(most) + 1)  # rounding of the bounds themselves
        least, most = least - slack, most + slack
        n = len(node)
        need = np.partition(least, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        i, j = np.nonzero(most >= need[:, None])
        return pa.table({"query": query["node"].to_numpy()[i], "node": node[j], "least": least[i, j], "most": most[i, j]})

    return run


def top_inner_products(vectors: DataFrame, queries, k: int, scale: int = 64) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query row, which is no candidate of its own.

    ``vectors`` has vec_id and embedding; each component x counts as floor(scale * x). ``queries`` is a condition
    on vec_id. Vectors that are null, empty or hold null or non-finite components and rows with a null vec_id take
    no part. Only vectors of one dimension are compared; a repeated vec_id is one row for each different vector.
    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id, and a query with fewer than
    ``k`` candidates gets them all. Scores are exact; floor(scale * x) and the scores must be longs, others are an error.
    """
    sound = ("vec_id is not null and vector is not null and size(vector) > 0 and "
             "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) as vector").where(sound)
    rows = stored(rows.selectExpr("vec_id", f"transform(vector, x -> cast(floor({scale} * x) as double)) as vector",
                                  "size(vector) as dims").distinct(), "vectors")
    found = [_one_dimension(rows.where(F.col("dims") == d), queries, k)
             for (d,) in rows.select("dims").distinct().collect()]  # dimensions, not vectors
    if not found:
        return rows.selectExpr("vec_id as query_id", "0 as rank", "vec_id", "0L as score")
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


def _one_dimension(rows: DataFrame, queries, k: int) -> DataFrame:
    # The k + 1 smallest ids of equal vectors; the smallest names them all.
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    nodes = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).selectExpr(
        "ids[0] as node", "vector", "ids"), "nodes")
    ends = nodes.select(F.posexplode("vector")).groupBy("pos").agg(
        F.min("col"), F.max("col")).orderBy("pos").toArrow()  # two numbers for each dimension
    low, high = ends[1].to_numpy(), ends[2].to_numpy()
    step = np.maximum((high - low) / CELLS, 1e-12)

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.clip(np.floor((_matrix(batch.column("vector")) - low) / step), 0, CELLS - 1).astype(np.uint8)
                yield pa.record_batch([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())],
                                      names=["node", "cells"])

    spark = rows.sparkSession
    approximation = nodes.select("node", "vector").mapInArrow(cells, "node long, cells binary")
    asked = rows.where(queries).select("vec_id", "vector")
    # One search for each different query vector.
    asking = asked.groupBy("vector").agg(F.min("vec_id").alias("query"))
    counts = spark.range(1).select(
        F.lit(nodes.count()).alias("n"), F.lit(asking.count()).alias("m")).first()
    packs, lots = -(-counts["n"] // PACK), max(1, -(-counts["m"] // ASKED))
    side_a = approximation.withColumn("pack", F.expr(f"pmod(hash(node), {packs})")).withColumn(
        "lot", F.explode(F.expr(f"sequence(0, {lots} - 1)"))).selectExpr(
        "pack", "lot", "false as asked", "node", "cells", "cast(null as array<double>) as vector")
    side_q = asking.withColumn("lot", F.expr(f"pmod(hash(query), {lots})")).withColumn(
        "pack", F.explode(F.expr(f"sequence(0, {packs} - 1)"))).selectExpr(
        "pack", "lot", "true as asked", "query as node", "cast(null as binary) as cells", "vector")
    # k + 1 rows: the query itself may be the one to leave out.
    met = side_a.unionByName(side_q).groupBy("pack", "lot").applyInArrow(
        _bounds(k + 1, low, step), "query long, node long, least double, most double")
    met = stored(met, "bounds")
    by_least = Window.partitionBy("query").orderBy(F.desc("least"), "node")
    need = met.select("query", "least", F.row_number().over(by_least).alias("place")).where(
        F.col("place") == k + 1).select("query", F.col("least").alias("need"))
    alive = met.join(need, "query", "left").where("need is null or most >= need").select("query", "node", "most")
    by_most = Window.partitionBy("query").orderBy(F.desc("most"), "node")
    alive = stored(alive.withColumn("place", F.row_number().over(by_most)), "alive")

    def scored(pairs: DataFrame) -> DataFrame:
        product = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        if len(low) * max(np.abs(low).max(), np.abs(high).max()) ** 2 >= 2.0 ** 53:  # doubles would round
            x, y = (f"cast(cast({v} as long) as decimal(19,0))" for v in "xy")
            product = (f"aggregate(zip_with(a, b, (x, y) -> cast({x} * {y} as decimal(38,0))), cast(0 as decimal(38,0)), "
                       "(s, x) -> cast(s + x as decimal(38,0)))")
        return pairs.join(nodes.selectExpr("node", "vector as b"), "node").join(
            asking.selectExpr("query", "vector as a"), "query").selectExpr("query", "node", f"cast({product} as long) as score")

    first = stored(scored(alive.where(F.col("place") <= k + 1)), "first")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    sure = first.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == k + 1).selectExpr(
        "query", "score as sure")
    rest = scored(alive.where(F.col("place") > k + 1).join(sure, "query", "left").where(
        "sure is null or most >= sure"))
    best = first.unionByName(rest).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    # Back to rows: each query id with the ids of its best vectors.
    ids = best.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    few = ids.withColumn("place", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1).drop("place")
    per_query = asked.join(asking, "vector").selectExpr("vec_id as query_id", "query").join(few, "query").where(
        "query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return per_query.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
