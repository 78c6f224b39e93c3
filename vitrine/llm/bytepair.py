"""Byte-level BPE encoding and decoding by DuckDB queries inside each task.

Encoding: a text is cut by the tokenizer's pattern, its distinct stretches in Arrow where they are words of letters; the
distinct matches a task has not met yet become rows (word, tokens), the tokens as a string of one character each. A recursive query joins neighbouring tokens with the merge table
and contracts the leftmost pair of minimum rank of every word, with its equals further right that do not overlap it
(``replace``), until no pair of a word is in the table. (A contraction never makes a pair of lower rank: each token of
the vocabulary has one last merge, of two tokens of lower rank.) The ids of a text are those of its matches, in order.

Decoding: ids are cut before each token that begins with a space; for the stretches a task has not met yet (stretch,
position, token) rows join the vocabulary, and an ordered aggregation puts their bytes together. A text is its
stretches in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vitrine.llm.common import Runs, mixed, passed_on, slices

#: Matches whose ids a task remembers, and stretches of ids whose bytes it remembers.
REMEMBERED = 300_000
#: Words, and bytes of them, contracted by one query; tokens decoded by one query.
WORDS_AT_A_TIME, BYTES_AT_A_TIME, TOKENS_AT_A_TIME = 20_000, 1 << 18, 1 << 20
#: A token is the character of this code plus its id; the planes from here to ``END_CHAR`` hold no character that joins others.
FIRST_CHAR, END_CHAR = 0x40000, 0xE0000
AT_A_TIME = 4 << 20

#: Everything that any regular expression engine takes for white space.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: For this pattern a stretch of letters is one match, and a mark of ``MARKS`` after it the next.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN, MARKS = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$", (".", ",")

#: One contraction in every word of ``step`` that has a pair: a key holds the last round of its word only.
CONTRACT = """
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
  SELECT word, tokens FROM symbols
  UNION (
    WITH neighbours AS (
      SELECT word, unnest(each[:-2]) AS first, unnest(each[2:]) AS second
      FROM (SELECT word, string_split(tokens, '') AS each FROM step)),
    least AS (SELECT word, min(merged) AS merged FROM neighbours JOIN merges USING (first, second) GROUP BY word)
    SELECT word, replace(tokens, first || second, made)
    FROM step JOIN least USING (word) JOIN merges USING (merged)))
SELECT tokens FROM step ORDER BY word
"""
DECODE = """
SELECT stretch, from_hex(array_to_string(list(hex ORDER BY pos), '')) AS bytes
FROM tokens JOIN vocabulary USING (id) GROUP BY stretch ORDER BY stretch
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(first, second, merged) for every token of several bytes: the two tokens its last merge joins."""
    out = []
    for token, rank in ranks.items():
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found, i = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if found >= rank:
                raise ValueError(f"token {rank} is not reached by merges of lower rank")
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return np.array(out, np.int32).reshape(-1, 3)


def _characters(ids: np.ndarray) -> str:
    return (ids + np.int32(FIRST_CHAR)).astype("<u4").tobytes().decode("utf-32-le")


def _gathered(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of ``at``, one after the other."""
    first, own = np.cumsum(size) - size, size[at]
    ends = np.cumsum(own)
    return ids[np.repeat(first[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]


def _database():
    import duckdb

    # Without a folder to spill to: nothing is written on the machine.
    return duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})


class Encoder:
    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str):
        import regex

        self.find, self.plain = regex.compile(pattern).findall, pattern == KNOWN_PATTERN
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.base = _database()
        if max(ranks.values()) >= END_CHAR - FIRST_CHAR:
            raise ValueError("more ids than characters to stand for them")
        first, second, made = (list(_characters(column)) for column in merges.T)
        self.base.register("given", pa.table({
            "first": pa.array(first, pa.string()), "second": pa.array(second, pa.string()),
            "made": pa.array(made, pa.string()), "merged": merges[:, 2].copy()}))
        self.base.execute("CREATE TABLE merges AS SELECT * FROM given").fetchall()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int32)
        self.add(["", *MARKS])

    def add(self, new: list[str]) -> None:
        size, ids = self.contract(new)
        self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def contract(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        raws = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(lengths)
        sizes, ids, start = [], [], 0
        while start < len(raws):
            stop = min(start + WORDS_AT_A_TIME, len(raws),
                       max(start + 1, int(np.searchsorted(ends, ends[start] + BYTES_AT_A_TIME, side="right"))))
            symbols = _characters(self.byte[np.frombuffer(b"".join(raws[start:stop]), np.uint8)])
            bounds = (np.concatenate(([0], ends))[start:stop + 1] - (ends[start] - lengths[start])).tolist()
            self.base.register("symbols", pa.table({
                "word": np.arange(stop - start, dtype=np.int32),
                "tokens": [symbols[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}))
            found = self.base.execute(CONTRACT).fetchnumpy()["tokens"].tolist()
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append((np.frombuffer("".join(found).encode("utf-32-le"), np.uint32) - np.uint32(FIRST_CHAR)).astype(np.int32))
            start = stop
        return np.concatenate(sizes), np.concatenate(ids)

    def stretches(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each stretch, and all ids."""
        plain = pc.match_substring_regex(distinct, PLAIN) if self.plain else pa.repeat(False, len(distinct))
        words = distinct.filter(plain)
        stop, comma = (pc.ends_with(words, mark) for mark in MARKS)
        marks = pc.if_else(stop, 1, pc.if_else(comma, 2, 0)).to_numpy(zero_copy_only=False)
        words = pc.if_else(pc.or_(stop, comma), pc.ascii_rtrim(words, "".join(MARKS)), words)
        found = [self.find(s) for s in distinct.filter(pc.invert(plain)).to_pylist()]
        others = np.fromiter(map(len, found), np.int64, len(found))
        matches = pa.concat_arrays([words, pa.array(chain.from_iterable(found), pa.string())]).dictionary_encode()
        names = matches.dictionary.to_pylist()
        if len(self.place) > REMEMBERED:
            self.forget()
        if new := [m for m in names if m not in self.place]:
            self.add(new)
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[matches.indices.to_numpy()]
        # A word of letters is two matches, the second is empty or its mark.
        plain, size = plain.to_numpy(zero_copy_only=False), np.full(len(distinct), 2)
        size[~plain] = others
        ends = np.cumsum(size)
        first, places = ends - size, np.empty(size.sum(), np.int64)
        places[first[plain]], places[first[plain] + 1] = at[:len(words)], marks
        places[np.repeat(first[~plain] - (np.cumsum(others) - others), others) + np.arange(others.sum())] = at[len(words):]
        bounds = np.concatenate(([0], np.cumsum(self.size[places])))[np.concatenate(([0], ends))]
        return np.diff(bounds), _gathered(self.ids, self.size, places)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and all ids.

        Texts are cut before each space, where no match of the pattern crosses, and equal stretches are looked up.
        The exception is white space on both sides of the cut; such texts are one stretch.
        """
        texts = pc.fill_null(texts, "")
        mixed = pc.match_substring_regex(texts, f"{SPACE} (?:{SPACE}|$)")
        lists = pc.split_pattern(texts, " ")
        if pc.any(mixed).as_py():
            whole = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), texts)
            lists = pc.if_else(mixed, whole, lists)
        pieces = lists.flatten().dictionary_encode()
        codes, distinct = pieces.indices.to_numpy().astype(np.int64), pieces.dictionary
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        head = np.zeros(len(codes), bool)
        head[bounds[:-1]] = True
        # A piece that does not begin its text has the space before it.
        key = np.where(head, 2 * codes, 2 * codes + 1)
        used = np.flatnonzero(np.bincount(key, minlength=1))
        number = np.zeros(2 * len(distinct) + 2, np.int64)
        number[used] = np.arange(len(used))
        at, pieces = number[key], distinct.take(pa.array(used >> 1))
        spaced = pc.binary_join_element_wise(" ", pieces, "")
        size, ids = self.stretches(pc.if_else(pa.array((used & 1).astype(bool)), spaced, pieces))
        ends = np.concatenate(([0], np.cumsum(size[at])))
        return ends[bounds], _gathered(ids, size, at)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.base = _database()
        self.base.register("given", pa.table({"id": pa.array(list(ranks.values()), pa.int32()),
                                              "hex": [token.hex() for token in ranks]}))
        self.base.execute("CREATE TABLE vocabulary AS SELECT * FROM given").fetchall()
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.bytes = pa.array([], pa.binary())

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The bytes of texts of these numbers of ids."""
        if not len(ids):
            return pa.array([b""] * len(sizes), pa.binary())
        if not 0 <= int(ids.min()) <= int(ids.max()) < len(self.begins):
            raise ValueError("an id is not in the vocabulary")
        bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        cut = self.begins[ids]
        cut[bounds[:-1][sizes > 0]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(ids))
        prints, example, at = np.unique(Runs(mixed(ids.astype(np.uint64) + np.uint64(1))).of(first, last),
                                        return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED:
            self.forget()
        names = prints.tolist()
        new = np.fromiter((i for i, p in enumerate(names) if p not in self.place), np.int64)
        if len(new):
            begin, size = first[example[new]], (last - first)[example[new]]
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            self.base.register("tokens", pa.table({
                "stretch": np.repeat(np.arange(len(new)), size), "pos": pos, "id": ids[np.repeat(begin, size) + pos]}))
            found = self.base.sql(DECODE).to_arrow_table()["bytes"].combine_chunks().cast(pa.binary())
            if len(found) != len(new):
                raise ValueError("an id is not in the vocabulary")
            self.place.update(zip(prints[new].tolist(), range(len(self.bytes), len(self.bytes) + len(new)), strict=True))
            self.bytes = pa.concat_arrays([self.bytes, found])
        index = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        parts = self.bytes.take(pa.array(index[at]))
        _, offsets, data = parts.buffers()  # all parts, one after the other: a text only needs its bounds
        ends = np.frombuffer(offsets, np.int32)[np.searchsorted(first, bounds)]
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), data])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with ids array<int>: each whole text, a null one like an empty one (no ids).

    Rows are encoded one by one, so repeated rows and an empty table need no rule; other columns are ignored.
    Special tokens are ordinary text. The vocabulary and merge table that go to the tasks are those of the file.
    """
    sent = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value, pattern)
        for part in slices(batches, AT_A_TIME):
            bounds, ids = encoder.encode(part.column("text"))
            arrays = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids, pa.int32()))
            yield pa.record_batch([*(part.column(c) for c in keep), arrays], names=[*keep, "ids"])

    used = docs.select(*keep, docs["text"].cast("string").alias("text"))
    return used.mapInArrow(run, passed_on(used, keep, "ids array<int>"))


def decode(encoded: DataFrame, ranks: dict[bytes, int], *keep: str) -> DataFrame:
    """``keep`` columns of ``encoded`` with bytes binary: its ids' bytes; null or no ids give no bytes.

    An id that the vocabulary does not have is an error.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(sizes, dtype=np.int64), 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + TOKENS_AT_A_TIME, side="right")))
                part = batch.slice(start, stop - start)
                texts = decoder.decode(part.column("ids").flatten().to_numpy(), sizes[start:stop])
                yield pa.record_batch([*(part.column(c) for c in keep), texts], names=[*keep, "bytes"])
                start = stop

    used = encoded.select(*keep, "ids")
    return used.mapInArrow(run, passed_on(used, keep, "bytes binary"))
