"""Phrase collocations by the stripes pattern.

A stripe is a prefix of words with a counter of the words that follow it; what follows no candidate counts under the
empty word, so that a stripe adds up to the prefix's own frequency. Tasks build stripes of their slices, and stripes
of equal prefix are merged elementwise after one shuffle. Three orders follow one another, each only where the one
before leaves candidates (a phrase is never more frequent than its parts):

0. the root stripe, whose counter holds the words themselves;
1. stripes of single words: frequencies of pairs;
2. stripes of pairs: frequencies of triples, totals of the pairs and the most frequent extension of each pair.

Candidates of the order before reach the tasks as bits of a table of fixed size: a bit set by chance only adds work.
Prefixes with a thousandth of all words or more (a thousand at most) are dealt out by the word that follows, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import slices, stored

#: Occurrences from which a phrase counts.
LEAST = 10
#: A phrase that a longer one contains is dropped if that one has this share of its occurrences.
SHARE, OF = 50, 100
TOP = 2000
#: Bits of the table of candidates: 16 MB, whatever the input.
BITS = 1 << 27
#: A prefix with this part of all words is dealt to SHARDS places.
HOT, SHARDS = 1000, 64
#: Bytes of text taken apart at a time.
AT_A_TIME = 6 << 20
#: Bytes of one bitmap of Spark's functions.
PAGE = 4096


class Words:
    """The words of a slice in order: ``at`` has a number for each (-1 between pieces and documents)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        marked = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern="[.,;:!?\n-\r]+",
                                            replacement=" . ")
        lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(marked, ".", " "))
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        full = pc.greater(pc.binary_length(flat), 0)
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))[offsets - offsets[0]]
        encoded = flat.filter(full).dictionary_encode()
        codes, size = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
        lang = langs.dictionary_encode()
        tongue = np.repeat(lang.indices.to_numpy().astype(np.int64), np.diff(ends))
        found, at = np.unique(tongue * max(size, 1) + codes, return_inverse=True)
        self.words = encoded.dictionary.take(pa.array(found % max(size, 1)))
        self.langs = lang.dictionary.take(pa.array(found // max(size, 1)))
        real = pc.not_equal(self.words, ".").to_numpy(zero_copy_only=False)
        self.at = np.where(real[at], at, -1) if len(at) else at.astype(np.int64)
        self.counts = np.bincount(self.at[self.at >= 0], minlength=len(found))

    def seeds(self) -> list[int]:
        """What hashes of phrases of each word's language begin with."""
        known = {x: xxhash.xxh64_intdigest(x, 42) for x in self.langs.unique().to_pylist()}
        return [known[x] for x in self.langs.to_pylist()]


def _hashes(strings: pa.Array, seeds) -> np.ndarray:
    """The same numbers as Spark's ``xxhash64`` over the language and the words."""
    digest = xxhash.xxh64_intdigest
    values = (digest(x, s) for x, s in zip(strings.to_pylist(), seeds, strict=True))
    return np.fromiter(values, np.uint64, len(strings))


def _is_set(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(BITS)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, AT_A_TIME):
        words = Words(part.column("text"), part.column("lang"))
        real = np.flatnonzero(words.counts)
        yield pa.record_batch([words.langs.take(pa.array(real)), words.words.take(pa.array(real)),
                               pa.array(words.counts[real])], names=["lang", "next", "n"])


def _stripes(order: int, table, hot):
    """A ``mapInArrow`` function: the stripes of one order of each slice.

    ``table`` is a broadcast table of the candidates of the order before, ``hot`` the broadcast (lang, prefix) that are
    dealt out by what follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, spread = np.frombuffer(table.value, np.uint8), hot.value
        for part in slices(batches, AT_A_TIME):
            words = Words(part.column("text"), part.column("lang"))
            at, size = words.at, len(words.words)
            if order == 1:
                known = np.append(_is_set(bits, _hashes(words.words, words.seeds())), False)
                start = np.flatnonzero(known[at])
                prefix, then = at[start], np.append(at, -1)[start + 1]
                follows = known[then]
            else:
                pair = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) if size else np.zeros(0, np.int64)
                distinct, which = np.unique(at[pair] * size + at[pair + 1], return_inverse=True)
                seeds, names = words.seeds(), words.words.to_pylist()
                digest = xxhash.xxh64_intdigest
                hashes = np.fromiter((digest(names[b], digest(names[a], seeds[a])) for a, b in zip(
                    (distinct // max(size, 1)).tolist(), (distinct % max(size, 1)).tolist(), strict=True)),
                    np.uint64, len(distinct))
                known = np.append(_is_set(bits, hashes)[which], False) if len(pair) else np.zeros(1, bool)
                place = np.full(len(at) + 1, -1)  # of the pair that begins at each word
                place[pair] = np.arange(len(pair))
                start = pair[known[:-1]]
                prefix, then = which[place[start]], np.append(at, [-1, -1])[start + 2]
                follows = known[place[start + 1]]
            then = np.where(follows, then, size)
            key, n = np.unique(prefix * (size + 1) + then, return_counts=True)
            prefix, then = key // (size + 1), key % (size + 1)
            one = prefix if order == 1 else distinct[prefix] // size
            lang = words.langs.take(pa.array(one))
            name = words.words.take(pa.array(one))
            if order == 2:
                name = pc.binary_join_element_wise(name, words.words.take(pa.array(distinct[prefix] % size)), " ")
            nexts = pa.concat_arrays([words.words, pa.array([""], pa.string())]).take(pa.array(then))
            shard = np.zeros(len(key), np.int64)
            first = np.flatnonzero(np.diff(prefix, prepend=-1))
            last = np.append(first[1:], len(key))
            for i, pair_name in enumerate(zip(lang.take(pa.array(first)).to_pylist(), name.take(pa.array(first)).to_pylist(),
                                              strict=True)):
                if pair_name in spread:
                    here = slice(first[i], last[i])
                    shard[here] = [xxhash.xxh64_intdigest(x) % SHARDS for x in nexts[here].to_pylist()]
            dealt = np.lexsort((shard, prefix))
            heads = np.flatnonzero((np.diff(prefix[dealt], prepend=-1) != 0) | (np.diff(shard[dealt], prepend=-1) != 0))
            bounds = pa.array(np.append(heads, len(key)).astype(np.int32))
            taken, head = pa.array(dealt), pa.array(dealt[heads])
            yield pa.record_batch(
                [lang.take(head), name.take(head), pa.array(shard[dealt[heads]].astype(np.int32)),
                 pc.binary_join(pa.ListArray.from_arrays(bounds, nexts.take(taken)), " "),
                 pa.ListArray.from_arrays(bounds, pa.array(n[dealt].astype(np.int32)))],
                names=["lang", "prefix", "shard", "nexts", "counts"])

    return run


def _candidates(df: DataFrame, *columns: str) -> bytes:
    """A table of BITS bits with the hash of each row's ``columns`` set; its size does not depend on the rows."""
    place = F.xxhash64(*columns).bitwiseAND(BITS - 1)
    pages = df.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(32767).alias("bit")).groupBy("page").agg(
        F.bitmap_construct_agg("bit").alias("bits"))
    table = bytearray(BITS // 8)
    for row in pages.collect():
        table[row["page"] * PAGE:(row["page"] + 1) * PAGE] = row["bits"]
    return bytes(table)


def _merged(rows: DataFrame, order: int, table: bytes, hot: list) -> DataFrame:
    """Stripes of one order over all documents, one row for each candidate entry and one for all others together."""
    context = rows.sparkSession.sparkContext
    told = context.broadcast(table), context.broadcast({(r[0], r[1]) for r in hot})
    made = rows.mapInArrow(_stripes(order, *told), "lang string, prefix string, shard int, nexts string, counts array<int>")
    entries = made.repartition("lang", "prefix", "shard").select(
        "lang", "prefix", "shard", F.inline(F.arrays_zip(
            F.split("nexts", " ").alias("next"), F.col("counts").alias("n"))))
    summed = entries.groupBy("lang", "prefix", "shard", "next").agg(F.sum("n").alias("n"))
    folded = summed.groupBy("lang", "prefix", "shard", F.when(F.col("n") >= LEAST, F.col("next")).otherwise("").alias(
        "next")).agg(F.sum("n").alias("n"))
    out = stored(folded, f"stripes{order}")
    for value in told:
        value.unpersist()
    return out


def _look_up(df: DataFrame, counts: DataFrame, hot: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``counts.n`` of (lang, ``key``) as ``out``.

    Keys that many rows may share come from the small table ``hot``; their rows are spread over the large join by a key
    of their own that nothing has.
    """
    small = F.broadcast(hot.select("lang", F.col("phrase").alias(key), F.col("n").alias("hot_n")))
    large = counts.select("lang", F.col("phrase").alias("cold_key"), F.col("n").alias("cold_n"))
    cold = F.when(F.col("hot_n").isNull(), F.col(key)).otherwise(F.concat(F.lit("   "), "phrase"))
    joined = df.join(small, ["lang", key], "left").withColumn("cold_key", cold).join(large, ["lang", "cold_key"], "left")
    return joined.withColumn(out, F.coalesce("hot_n", "cold_n")).drop("hot_n", "cold_n", "cold_key")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of two and three words of every language.

    ``docs`` has text and lang; other columns are ignored. A null text has no words, a null language is ``und``. Every
    row counts, repeated rows too. Equal scores are ordered by frequency, then by the phrase's bytes. Tables without a
    phrase of LEAST occurrences, and empty ones, give an empty result.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = stored(rows.mapInArrow(_root, "lang string, next string, n long").groupBy("lang", "next").agg(
        F.sum("n").alias("n")).withColumnRenamed("next", "phrase"), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    all_words = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= LEAST)

    def often(df: DataFrame) -> DataFrame:
        return df.where(F.col("n") * HOT >= max(all_words, 1))  # HOT rows at most

    hot_words = often(frequent).collect()
    ones = _merged(rows, 1, _candidates(frequent, "lang", "phrase"), hot_words)
    pairs = ones.where("next <> ''").select(
        "lang", F.col("prefix").alias("first"), F.col("next").alias("last"), F.col("n").alias("a"),
        F.concat_ws(" ", "prefix", "next").alias("phrase"))
    hot_pairs = often(pairs.withColumn("n", F.col("a"))).select("lang", "phrase").collect()
    twos = _merged(rows, 2, _candidates(pairs, "lang", "first", "last"), hot_pairs)
    whole = stored(twos.groupBy("lang", F.col("prefix").alias("phrase")).agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("next") != "", F.col("n"))).alias("longer")), "prefixes")
    triples = twos.where("next <> ''").select(
        "lang", F.col("prefix").alias("head"), F.col("next").alias("last"), F.col("n").alias("a"),
        F.substring_index("prefix", " ", 1).alias("first"),
        F.concat_ws(" ", F.substring_index("prefix", " ", -1), "next").alias("tail"),
        F.concat_ws(" ", "prefix", "next").alias("phrase"))
    behind = triples.groupBy("lang", F.col("tail").alias("phrase")).agg(F.max("a").alias("before"))

    hot_words, hot_whole = often(words), often(whole)
    two = pairs.join(whole.select("lang", "phrase", "longer"), ["lang", "phrase"], "left").join(
        behind, ["lang", "phrase"], "left")
    longest = F.coalesce(F.greatest("longer", "before"), F.lit(0))
    two = two.where(OF * longest < SHARE * F.col("a")).select("lang", "first", "last", "phrase", "a")
    two = _look_up(_look_up(two, words, hot_words, "first", "l"), words, hot_words, "last", "r")
    two = two.select("lang", "phrase", "a", "l", "r", _score("l", "r").alias("score"))
    three = _look_up(_look_up(triples, words, hot_words, "first", "l1"), words, hot_words, "last", "r2")
    three = _look_up(_look_up(three, whole, hot_whole, "head", "l2"), whole, hot_whole, "tail", "r1")
    one, other = _score("l1", "r1"), _score("l2", "r2")
    early = one <= other
    three = three.select(
        "lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(
            F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least(one, other).alias("score"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # First the best of each of SHARDS parts, so that one task ranks SHARDS * top rows of a language at most.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))).orderBy(
        F.desc("score"), F.desc("a"), "phrase")
    scored = two.unionByName(three).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = scored.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(left: str, right: str):
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits: exact up to frequencies of 10**15."""
    a, l, r = (f"cast({c} as decimal(15,0))" for c in ("a", left, right))
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {a} * {a}) div ({l} * {r})")


def duckdb_sql() -> str:
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
cut AS MATERIALIZED (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces)),
spots AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM cut),
one AS MATERIALIZED (SELECT lang, x AS p, count(*) AS n FROM spots GROUP BY ALL),
two AS MATERIALIZED (SELECT lang, x, y, x || ' ' || y AS p, count(*) AS n FROM spots WHERE y IS NOT NULL GROUP BY ALL
  HAVING count(*) >= {LEAST}),
three AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS n FROM spots WHERE z IS NOT NULL GROUP BY ALL
  HAVING count(*) >= {LEAST}),
cuts AS (SELECT c.lang, c.p, c.n AS a, 1 AS j, l.n AS l, r.n AS r FROM two c
    JOIN one l ON l.lang = c.lang AND l.p = c.x JOIN one r ON r.lang = c.lang AND r.p = c.y
  UNION ALL SELECT c.lang, x || ' ' || y || ' ' || z, c.n, 1, l.n, r.n FROM three c
    JOIN one l ON l.lang = c.lang AND l.p = x JOIN (SELECT lang, p, n FROM two) r ON r.lang = c.lang AND r.p = y || ' ' || z
  UNION ALL SELECT c.lang, x || ' ' || y || ' ' || z, c.n, 2, l.n, r.n FROM three c
    JOIN (SELECT lang, p, n FROM two) l ON l.lang = c.lang AND l.p = x || ' ' || y JOIN one r ON r.lang = c.lang AND r.p = z),
lowest AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inside AS (SELECT lang, p, max(n) AS longer FROM (SELECT lang, x || ' ' || y AS p, n FROM three
  UNION ALL SELECT lang, y || ' ' || z, n FROM three) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r,
  CAST(t.n AS BIGINT) AS n, score
FROM lowest JOIN (SELECT lang, sum(n) AS n FROM one GROUP BY lang) t USING (lang) LEFT JOIN inside i USING (lang, p)
WHERE coalesce({OF} * i.longer < {SHARE} * a, true)
QUALIFY rank <= {TOP}
"""
