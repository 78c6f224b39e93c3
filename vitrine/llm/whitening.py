"""Whitening of vectors by QDWH spectral divide and conquer.

Vectors become whole numbers, whose sums and centred second moments every task adds up for its rows; the covariance (at
most DIMS x DIMS, whatever the number of rows) is taken apart on the driver: the polar factor of the covariance less a
shift is +1 on the eigenvectors above the shift and -1 below, so it gives the projectors on two invariant subspaces,
and each is split again until only single components are left. The components go to all tasks as one small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stored

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned.
COMPONENTS = 32
#: The longest vectors that are taken.
DIMS = 4096
#: Vectors handled at a time.
ROWS = 4096
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- spectral divide and conquer


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, nonsingular matrix, by dynamically weighted Halley iterations."""
    size = len(a)
    x = a / np.linalg.norm(a)
    low = 1.0 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(size))
    low = min(max(low, 1e-17), 1.0)
    eye = np.eye(size)
    for _ in range(50):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        u = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        if w > 100:  # far from orthogonal: the QR form is the stable one
            q = np.linalg.qr(np.vstack((np.sqrt(w) * x, eye)))[0]
            new = v / w * x + (u - v / w) / np.sqrt(w) * (q[:size] @ q[size:].T)
        else:
            new = v / w * x + (u - v / w) * np.linalg.solve(eye + w * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        low = min(low * (u + v * square) / (1 + w * square), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.cbrt(4 * EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> np.ndarray | None:
    """Bases of the invariant subspaces above and below ``shift``, side by side with the number above; None if one is
    empty."""
    size = len(a)
    moved = a - shift * np.eye(size)
    try:
        projector = (polar(moved) + np.eye(size)) / 2
    except np.linalg.LinAlgError:  # the shift is an eigenvalue
        return None
    above = int(round(np.trace(projector)))
    if not np.isfinite(projector).all() or not 0 < above < size:
        return None
    basis = projector @ rng.normal(size=(size, above))
    for _ in range(2):
        basis = projector @ np.linalg.qr(basis)[0]
    whole = np.linalg.qr(basis, mode="complete")[0]
    return whole, above


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; the largest entry is positive."""
    size = len(a)
    if not size:
        return np.zeros(0), np.zeros((0, 0))
    rng = np.random.default_rng(12)
    norm = np.linalg.norm(a)
    vectors, waiting = np.zeros((size, size)), [(np.eye(size), (a + a.T) / 2)]
    done = 0
    while waiting:
        basis, part = waiting.pop()
        n = len(part)
        if n == 1 or np.linalg.norm(part - np.diag(np.diag(part))) <= EPS * norm / size:
            vectors[:, done:done + n] = basis
            done += n
            continue
        middle, width = np.median(np.diag(part)), np.linalg.norm(part - np.trace(part) / n * np.eye(n))
        for shift in (middle, np.trace(part) / n, np.trace(part) / n + width * 1e-3, np.trace(part) / n - width * 1e-3):
            found = _split(part, shift, rng)
            if found:
                break
        if not found:  # equal eigenvalues, to working precision: any basis will do
            vectors[:, done:done + n] = basis
            done += n
            continue
        whole, above = found
        for side in (whole[:, above:], whole[:, :above]):
            inner = side.T @ part @ side
            waiting.append((basis @ side, (inner + inner.T) / 2))
    vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = np.abs(vectors).argmax(0)
    return values[order], vectors * np.where(vectors[largest, np.arange(size)] < 0, -1.0, 1.0)


# ---------------------------------------------------------------- inside tasks


def _whole(batches: Iterator[pa.RecordBatch], only: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with finite vectors of one length (``only``, or each length in turn) and their whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            part = part.filter(pc.is_valid(part.column("vector")))
            sizes = pc.list_value_length(part.column("vector")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]) if only is None else [only]:
                same = part.filter(pa.array(sizes == size))
                flat = pc.fill_null(same.column("vector").flatten(), float("nan"))
                m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                fine = np.isfinite(m).all(1)
                m = np.floor(SCALE * m[fine])
                if (np.abs(m) > 2.0 ** 62).any():
                    raise ValueError(f"a component is too large to become a long by floor({SCALE} * c)")
                yield same.filter(pa.array(fine)), m.astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, x in _whole(batches):
        if x.size:
            n, size = x.shape
            yield pa.record_batch(
                [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                 pa.array((x >> 31).sum(0)), pa.array((x & ((1 << 31) - 1)).sum(0)),
                 pa.array(np.full(size, n, np.int64))], names=["size", "i", "high", "low", "n"])


class Centre:
    """The exact mean S / n of each dimension as a whole part and a rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def moved(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The exact sum of (n * x - S)^2 over the dimensions; null where it is no long."""
        away = x - self.whole
        rough = (((away.astype(np.float64) - self.rest / self.n) * self.n) ** 2).sum(1)
        if rough.max(initial=0) < 2.0 ** 60:
            return pa.array(((self.n * away - self.rest) ** 2).sum(1))
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero(rough < 2.0 ** 64):
            exact = sum((self.n * a - r) ** 2 for a, r in zip(away[i].tolist(), self.rest.tolist(), strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return pa.array(out, pa.int64())


def _moments(centre, matrix):
    """A ``mapInArrow`` function: second moments of the centred rows, times ``matrix`` where there is one, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m = centre.value, matrix.value if matrix else None
        total = None
        for _, x in _whole(batches, len(c.whole)):
            y = c.moved(x) if m is None else c.moved(x) @ m
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))],
                                  names=["i", "row"])

    return run


def _summed(rows: DataFrame, centre, matrix, size: int) -> np.ndarray:
    parts = rows.mapInArrow(_moments(centre, matrix), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return (out + out.T) / 2


def whiten(vectors: DataFrame, column: str = "embedding", top: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and component.

    ``vectors`` has vec_id and ``column``; other columns are ignored. A vector that is null or holds a null or
    non-finite entry takes no part, nor does one whose length is not the commonest (of equally common ones the
    smallest) or 0; rows with equal or null ids are rows like others. Where a component has no variance (one vector,
    equal vectors, or fewer vectors than dimensions) ``whitened`` is 0 and the identity error leaves it out; without
    any variance ``explained`` is 0. ``deviation`` is null where it exceeds a long. Components of more than 2**62 / 64
    and vectors of more than DIMS entries are refused with an error. Without vectors the result is empty.
    """
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("vector"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = stored(rows.select("vector").mapInArrow(_sums, "size int, i int, high long, low long, n long").groupBy(
        "size", "i").agg(F.sum(F.col("high").cast("decimal(20,0)")).alias("high"),
                         F.sum(F.col("low").cast("decimal(20,0)")).alias("low"), F.sum("n").alias("n")), "sums")
    best = found.where("i = 0").orderBy(F.desc("n"), "size").limit(1).select("size", "n").collect()
    context = vectors.sparkSession.sparkContext
    if not best:
        return vectors.sparkSession.createDataFrame([], schema.format(kind))
    size, n = best[0]
    if size > DIMS:
        raise ValueError(f"vectors of {size} entries; at most {DIMS} are taken")
    sums = {r["i"]: int(r["high"]) * (1 << 31) + int(r["low"]) for r in found.where(F.col("size") == size).collect()}
    centre = context.broadcast(Centre(n, [sums[i] for i in range(size)]))
    covariance = _summed(rows.select("vector"), centre, None, size) / n
    values, basis = components(covariance)
    values, basis = values[:top], basis[:, :top]
    real = values > 4 * size * EPS * max(values.max(initial=0), 0)
    scaled = basis * np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)
    matrix = context.broadcast(scaled)
    off = np.abs(_summed(rows.select("vector"), centre, matrix, len(values)) / n - np.eye(len(values)))
    error = float(off[np.ix_(real, real)].max(initial=0.0))
    trace = float(np.trace(covariance))
    shares = [float(v) / trace if trace > 0 else 0.0 for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m = centre.value, matrix.value
        for part, x in _whole(batches, size):
            z = c.moved(x) @ m
            yield pa.record_batch([part.column("vec_id"), c.deviation(x), pa.FixedSizeListArray.from_arrays(
                pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))], names=["vec_id", "deviation", "z"])

    moved = rows.mapInArrow(run, f"vec_id {kind}, deviation long, z array<double>")
    long = moved.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                       "whitened", F.array(*map(F.lit, shares))[F.col("k")].alias("explained"),
                       F.lit(error).alias("identity_error"))
