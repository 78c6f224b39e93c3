"""What several of the operators share: bounded slices of Arrow batches, words, fingerprints, stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.session import materialize, prepare

#: Text of so many bytes at most (or one document) is taken apart at a time, whatever the batch holds.
SLICE_BYTES = 3 << 19
#: 64-bit odd constants of the rolling fingerprints and of the final mix (fixed values of splitmix64 and xxHash).
MIX_A, MIX_B, MIX_C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again, so that a lost executor costs no recomputation."""
    return materialize(df, label)


def part_of(column: str, parts: int):
    """crc32 of the value as text, modulo ``parts``; -1 where the value is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(-1))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds ``size`` bytes of text or one row."""
    for batch in batches:
        pa.default_memory_pool().release_unused()  # workers live on into later stages
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, n = 0, batch.num_rows
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-space separated words: code of each word, first word of each text (one more at the end), distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    encoded = flat.filter(full).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), kept[offsets], encoded.dictionary


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``coded_words`` with the distinct words as a list."""
    codes, offsets, distinct = coded_words(texts)
    return codes, offsets, distinct.to_pylist()


def passed_on(used: DataFrame, keep: tuple[str, ...], added: str) -> StructType:
    """The schema of the ``keep`` columns of ``used`` followed by the fields of the DDL string ``added``."""
    return StructType([used.schema[c] for c in keep] + StructType.fromDDL(added).fields)


def fingerprints(strings: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s.encode(), seed) for s in strings), dtype=np.uint64, count=len(strings))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_B)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_C)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Fingerprints of any runs of consecutive values of one array: run [a, b) is compared by value, not by place."""

    INVERSE = pow(MIX_A, -1, 1 << 64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power, self.shift = np.full(n, MIX_A, np.uint64), np.full(n + 1, self.INVERSE, np.uint64)
        if n:
            power[0] = 1
        self.shift[0] = 1
        np.cumprod(self.shift, out=self.shift)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power))))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = (stop - start).astype(np.uint64)
        return mixed((self.sums[stop] - self.sums[start]) * self.shift[start] + size * np.uint64(MIX_B))
