"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting: each task adds up the hashed n-grams of its texts per language and gives one row per language and bucket
it saw, so the shuffle is bounded by tasks x languages x buckets. The log-probability matrix (buckets x languages,
the bound of the broadcast) goes to every task, which scores whole texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import passed_on, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages a task counts at a time; more are written out early.
OPEN_LANGUAGES = 64
#: Bytes of text taken apart at a time: every character becomes several numbers.
AT_A_TIME = 1 << 19


def hashed_grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that begins at each character, by order (-1 past a text's end), and the texts' bounds.

    Letters are lower-cased; ASCII characters that are no letters count as a space.
    """
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    points = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    sizes = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    points[(points < 97) | ((points > 122) & (points < 128))] = 32
    room = np.repeat(bounds[1:], sizes) - np.arange(len(points))
    mixed = points * np.uint32(0x9E3779B1)
    grams, key = [], np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        key = (key ^ np.concatenate((mixed[n - 1:], np.zeros(min(n - 1, len(mixed)), np.uint32)))) * np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(15)
        if n in ORDERS:
            grams.append(np.where(room >= n, ((key * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int32), -1))
    return grams, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def rows():
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                                  names=["lang", "bucket", "n"])
        totals.clear()

    for part in slices(batches, AT_A_TIME):
        for lang in pc.unique(part.column("lang")).to_pylist():
            if lang not in totals and len(totals) >= OPEN_LANGUAGES:
                yield from rows()
            total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            grams, _ = hashed_grams(part.column("text").filter(pc.equal(part.column("lang"), lang)))
            for g in grams:
                total += np.bincount(g[g >= 0], minlength=BUCKETS)
    yield from rows()


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities, (BUCKETS + 1) x languages; the last row is 0.

    ``labelled`` has text and lang; rows with a null in either teach nothing. Texts weigh by their length and the
    languages' own frequencies are not used.
    """
    used = labelled.selectExpr("cast(text as string) text", "cast(lang as string) lang").dropna()
    counts = (used.mapInArrow(_count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(pc.unique(counts["lang"]).to_pylist())
    matrix = np.zeros((BUCKETS + 1, len(langs)), np.float64)
    at = pc.index_in(counts["lang"].combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    matrix[counts["bucket"].to_numpy(), at] = counts["n"].to_numpy()
    matrix[:-1] = np.log(matrix[:-1] + SMOOTHING) - np.log(matrix.sum(0) + SMOOTHING * BUCKETS)
    matrix[-1] = 0
    return langs, matrix.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score, the posterior probability of that language.

    A text that is null or has no letter, and every text if the model knows no language, is ``und`` with score 0.
    Ties go to the language that comes first in the alphabet.
    """
    langs, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, AT_A_TIME):
            best, top = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
            if langs:
                grams, bounds = hashed_grams(part.column("text"))
                per_char = sum(m[g] for g in grams)
                sums = np.add.reduceat(np.concatenate((per_char, np.zeros((1, len(langs)), np.float32))),
                                       bounds[:-1], axis=0, dtype=np.float64)
                sums[bounds[1:] == bounds[:-1]] = 0
                best = sums.argmax(1)
                top = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            known = part.column("letters").to_numpy(zero_copy_only=False) & bool(langs)
            names = [langs[i] if ok else "und" for i, ok in zip(best, known, strict=True)]
            columns = [part.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(np.where(known, top, 0.0))]
            yield pa.record_batch(columns, names=[*keep, "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    used = docs.select(*keep, F.col("text").cast("string").alias("text"), letters.alias("letters"))
    return used.mapInArrow(score, passed_on(used, keep, "lang_pred string, score double"))
