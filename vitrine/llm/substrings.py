"""Long repeated word sequences, found on a compacted De Bruijn graph of the corpus.

Every window of WIDTH words is an edge between its first and last WIDTH - 1 words. Of the word K-mers in a window
the one with the smallest fingerprint is its anchor, a choice made by content alone: equal windows have equal
anchors, and the windows around one anchor are a path of edges that begins and ends with the anchor's place. So one
row per anchor and document stands for the whole path (about one for 18 words).

1. Paths whose anchor occurs in one document only are dropped: a join with the anchors' smallest and largest doc_id.
2. A path is nonbranching when its anchor has the same surroundings wherever it occurs. It stays compacted: all its
   edges first occur in the anchor's smallest document.
3. Only branching paths are taken apart into edges; a join with each edge's smallest document resolves them.
4. Words are marked at their source coordinates (document, first and last window). An edge or path counts as equal
   if anchor and surroundings agree, two fingerprints of 64 bits over different word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import MIX_C, Runs, fingerprints, mixed, passed_on, slices, stored, words

WIDTH = 50
K = 15


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, of different seeds, and the first word of each text."""
    codes, offsets, distinct = words(texts)
    return fingerprints(distinct)[codes], fingerprints(distinct, MIX_C)[codes], offsets


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, where the least of values[i : i + width] is, the first of equals."""
    best, size = np.arange(len(values)), 1

    def merge(step: int) -> np.ndarray:
        left, right = best[:-step], best[step:]
        return np.where(values[right] < values[left], right, left)

    while size * 2 <= width:
        best, size = merge(size), size * 2
    return merge(width - size) if size < width else best


def _paths(width: int, k: int):
    names = ["doc_id", "row_key", "anchor", "first", "last", "surroundings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, other, offsets = _hashes(part.column("text"))
            n = len(h)
            if n < width:
                continue
            starts = np.arange(n - k + 1)
            anchors = Runs(h).of(starts, starts + k)
            place = _leftmost_least(anchors, width - k + 1)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n - width + 1]
            window = np.flatnonzero(np.arange(n - width + 1) + width <= offsets[doc + 1])
            if not len(window):
                continue
            at = place[window]
            new = np.concatenate(([True], at[1:] != at[:-1]))
            first, last = window[new], window[np.concatenate((new[1:], [True]))]
            at, row = at[new], doc[first]
            around = Runs(other).of(first, last + width)
            around = mixed(around + (at - first).astype(np.uint64))
            rows = part.select(["doc_id", "row_key"]).take(pa.array(row))
            yield pa.record_batch([
                rows.column("doc_id"), rows.column("row_key"), pa.array(anchors[at].view(np.int64)),
                pa.array((first - offsets[row]).astype(np.int32)), pa.array((last - offsets[row]).astype(np.int32)),
                pa.array(around.view(np.int64))], names=names)

    return run


def _edges(width: int):
    names = ["doc_id", "row_key", "anchor", "edge", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, other, offsets = _hashes(part.column("text"))
            paths = part.column("paths")
            row = np.repeat(np.arange(part.num_rows), np.diff(paths.offsets.to_numpy()))
            anchor, first, last = (c.to_numpy() for c in paths.flatten().flatten())
            size = last - first + 1
            row, anchor, first = np.repeat(row, size), np.repeat(anchor, size), np.repeat(first, size)
            at = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
            begin = offsets[row] + at
            edge = Runs(other).of(begin, begin + width)
            rows = part.select(["doc_id", "row_key"]).take(pa.array(row))
            yield pa.record_batch([*rows.columns, pa.array(anchor), pa.array(edge.view(np.int64)),
                                   pa.array(at.astype(np.int32))], names=names)

    return run


def _strip(width: int, layout: bool):
    names = ["doc_id", "carried", "n_words", "n_removed", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            total, removed, kept = [], [], []
            for text, marks in zip(part.column("text"), part.column("marks"), strict=True):
                raw = text.as_py()
                found = (raw or "").encode().split()
                gone = 0
                if marks.is_valid:
                    first, last = (c.to_numpy() for c in marks.values.flatten())
                    edge = np.zeros(len(found) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + width, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    found = [w for w, c in zip(found, covered.tolist(), strict=True) if not c]
                total.append(len(found) + gone)
                removed.append(gone)
                kept.append(raw if layout and not gone else b" ".join(found).decode())
            yield pa.record_batch([part.column("doc_id"), part.column("carried"), pa.array(total, pa.int64()),
                                   pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = K, carry: tuple[str, ...] = (),
                   layout: bool = False) -> DataFrame:
    """Whole texts without the words of windows that also start in a document with a smaller doc_id.

    ``docs`` has doc_id and text; other columns are ignored. Returns doc_id, n_words, n_removed and kept_text (the
    words left, joined by one space) for every row, after them the ``carry`` columns of ``docs``. With ``layout``, a
    text that loses nothing stays as it is, white space and null included. A null or empty text has no words, one of fewer than ``width``
    words no window. Rows with a null doc_id keep all their words and take none from others; rows that share a
    doc_id never take from each other. An empty table gives an empty result.
    """
    if not 1 <= k <= width:
        raise ValueError("k lies between 1 and width")
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).alias("carried"))
    rows = whole.drop("carried")
    paths = stored(rows.where("doc_id is not null").mapInArrow(
        _paths(width, k),
        "doc_id long, row_key long, anchor long, first int, last int, surroundings long"), "paths")
    shared = paths.groupBy("anchor").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("other"),
        (F.min("surroundings") != F.max("surroundings")).alias("branching")).where("source < other").drop("other")
    repeated = stored(paths.drop("surroundings").join(shared, "anchor").where("branching or source < doc_id"),
                      "repeated")
    branching = repeated.where("branching").groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("anchor", "first", "last")).alias("paths"))
    # A row that occurs twice is taken apart once.
    edges = stored(rows.join(branching, ["doc_id", "row_key"]).mapInArrow(
        _edges(width), "doc_id long, row_key long, anchor long, edge long, at int"), "edges")
    sources = edges.groupBy("anchor", "edge").agg(F.min("doc_id").alias("source"))
    marks = edges.join(sources, ["anchor", "edge"]).where("source < doc_id").selectExpr(
        "doc_id", "row_key", "at as first", "at as last").unionByName(
        repeated.where("not branching").select("doc_id", "row_key", "first", "last"))
    marked = marks.distinct().groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("first", "last")).alias("marks"))
    joined = whole.join(marked, ["doc_id", "row_key"], "left").select("doc_id", "carried", "text", "marks")
    return joined.mapInArrow(_strip(width, layout), passed_on(
        joined, ("doc_id", "carried"), "n_words long, n_removed long, kept_text string")).select(
        "doc_id", "n_words", "n_removed", "kept_text", *(F.col("carried")[f"c{i}"].alias(c) for i, c in enumerate(carry)))
