"""Vector bin packing of documents into training sequences.

A sequence has three limits: tokens, segments (pieces of documents) and loss-bearing tokens. The piece that goes
next into an open sequence is the waiting one with the largest dot product of what it needs and what is left, both
as shares of the limits. Documents may be cut: what no waiting piece fits is filled with the head of one, and a
sequence that a limit closes early ends at a power of two, which needs no padding; the rest waits on.

Each task packs the rows it reads, in order, with at most LOOKAHEAD pieces waiting. Nothing is shuffled, and the
memory of a task does not depend on the size of the table.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vitrine.llm.common import coded_words, slices

MAX_TOKENS = 4096
MAX_SEGMENTS = 512
LOOKAHEAD = 512
#: Words whose ids a task remembers, without the marks that follow them.
REMEMBERED = 400_000
#: New words tokenized at a time, joined by spaces.
TOGETHER = 10_000
#: Bytes of text taken apart at a time.
AT_A_TIME = 4 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: Words that a tokenizer of the form ``_takes_letters_whole`` hands to its model as they are.
LETTERS = "^[a-zß-öø-ÿ]+$"
#: Marks taken off the end of a word; their places come after that of the empty word.
MARKS = (".", ",")
ID_OF = attrgetter("id")


def _byte_level() -> dict[int, str]:
    """The character that stands for each byte, as in GPT-2: printable ones themselves, the others from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(others)}


def _takes_letters_whole(tokenizer_file: str) -> bool:
    """Whether a lower-case word of Latin-1 letters reaches the model in one piece, with a character for each byte.

    That is so where texts are only composed, lower-cased and rid of white space, and then cut at runs of letters.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        rules = json.load(file)
    before, cut = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in before.get("normalizers", [])]
    pieces = [(c["type"], c.get("pattern"), c.get("behavior"), c.get("invert"), c.get("add_prefix_space"), c.get("use_regex"))
              for c in cut.get("pretokenizers", [])]
    return (steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
            and pieces == [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True,
                            None, None), ("ByteLevel", None, None, None, False, False)]
            and rules["truncation"] is None and not any(re.search(LETTERS, t["content"]) for t in rules["added_tokens"]))


def _gathered(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the words ``at``, one after the other."""
    first, own = np.cumsum(size) - size, size[at]
    ends = np.cumsum(own)
    return ids[np.repeat(first[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Token ids of words, each distinct word tokenized once while it is remembered."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model, self.bytes = self.tokenizer.model, _byte_level() | {32: " "}
        self.letters_whole = _takes_letters_whole(tokenizer_file)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}  # of words without the mark that follows
        self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.uint32)
        self.tokenize(pa.array(["", *MARKS]))

    def tokenize(self, new: pa.Array) -> None:
        """Words of plain letters go to the tokenizer's model, the others through the whole tokenizer."""
        whole = pc.match_substring_regex(new, LETTERS) if self.letters_whole else pa.repeat(False, len(new))
        letters, others = new.filter(whole).to_pylist(), new.filter(pc.invert(whole)).to_pylist()
        ids, size = [self.ids], [self.size]
        for start in range(0, len(others), TOGETHER):
            some = others[start:start + TOGETHER]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            owner = np.searchsorted(ends, np.array([a for a, _ in found.offsets], np.int64), side="right")
            ids.append(np.array(found.ids, np.uint32))
            size.append(np.bincount(owner, minlength=len(some)))
        if letters:
            pieces = " ".join(letters).encode().decode("latin-1").translate(self.bytes).split(" ")
            found = list(map(self.model.tokenize, pieces))
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(map(ID_OF, chain.from_iterable(found)), np.uint32, int(size[-1].sum())))
        self.ids, self.size = np.concatenate(ids), np.concatenate(size)
        self.places.update(zip(others + letters, range(len(self.places), len(self.places) + len(new)), strict=True))

    def split(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words as the tokenizer reads them, and the place of the mark that follows each.

        A full stop or comma after a letter is always a word of its own for the tokenizer, which lower-cases all but
        its special tokens.
        """
        lower = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, "<")))
        plain = pc.if_else(lower, pc.ascii_lower(distinct), distinct)
        marked = pc.match_substring_regex(plain, "[A-Za-z][.,]$")
        marks = pc.if_else(marked, pc.if_else(pc.ends_with(plain, MARKS[0]), 1, 2), 0)
        plain = pc.if_else(marked, pc.ascii_rtrim(plain, "".join(MARKS)), plain)
        return plain, marks.to_numpy(zero_copy_only=False).astype(np.int64)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        codes, offsets, distinct = coded_words(column)
        if len(self.places) > REMEMBERED:
            self.forget()
        plain, marks = self.split(distinct)
        plain = plain.dictionary_encode()
        names = plain.dictionary.to_pylist()
        at = np.fromiter((self.places.get(w, -1) for w in names), np.int64, len(names))
        if (new := at < 0).any():
            self.tokenize(plain.dictionary.filter(pa.array(new)))
            at[new] = [self.places[w] for w, n in zip(names, new.tolist(), strict=True) if n]
        at = np.stack((at[plain.indices.to_numpy()], marks), 1)  # the words of this column, then all their occurrences
        flat, size = _gathered(self.ids, self.size, at.ravel()), self.size[at].sum(1)
        ends = np.concatenate(([0], np.cumsum(size[codes])))[offsets]
        flat = _gathered(flat, size, codes)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield flat[a:b]


class Packer:
    """The waiting pieces and the sequences made of them."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, lookahead: int):
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self.next_id, self.lookahead = first_id, lookahead
        self.need = np.empty((0, 3))
        self.docs: list[tuple] = []  # (doc_id, tokens of the document), ids, start, first loss-bearing position
        self.out: list[tuple] = []

    def push(self, doc, ids: np.ndarray, start: int, loss_from: int) -> None:
        loss = max(0, start + len(ids) - max(start, loss_from))
        self.docs.append((doc, ids, start, loss_from))
        self.need = np.vstack((self.need, [[len(ids), 1, loss]]))

    def add(self, doc, ids: np.ndarray, loss_from: int) -> None:
        limit = int(min(self.limits[0], self.limits[2]))
        start = 0
        while len(ids) - start >= limit:  # fills a sequence by itself
            self.out.append((doc, start, ids[start:start + limit], self.next_id, 0))
            self.next_id += 1
            start += limit
        if start < len(ids):
            self.push(doc, ids[start:], start, loss_from)
        while len(self.docs) > self.lookahead:
            self.close()

    def take(self, i: int):
        self.need = np.delete(self.need, i, 0)
        return self.docs.pop(i)

    def close(self) -> None:
        """One sequence out of the waiting pieces."""
        left, chosen = self.limits.copy(), []
        while self.docs and left[0] > 0 and left[1] > 0:
            fits = (self.need <= left).all(1)
            if fits.any():
                gain = np.where(fits, (self.need / self.limits) @ (left / self.limits), -1.0)
                i = int(gain.argmax())
                size = self.need[i].copy()
                chosen.append(self.take(i))
            else:  # the head of the longest piece fills the gap, as far as the loss limit allows
                i = int(self.need[:, 0].argmax())
                doc, ids, start, loss_from = self.docs[i]
                free = max(0, loss_from - start)
                n = int(min(left[0], len(ids) - 1, free + left[2]))
                if n <= 0:
                    break
                self.take(i)
                self.push(doc, ids[n:], start + n, loss_from)
                chosen.append((doc, ids[:n], start, loss_from))
                size = np.array([n, 1, max(0, n - free)], dtype=np.float64)
            left -= size
        used = int(self.limits[0] - left[0])
        surplus = 0 if used == self.limits[0] else used - (1 << (used.bit_length() - 1))
        while surplus:  # back to a power of two
            doc, ids, start, loss_from = chosen.pop()
            n = max(0, len(ids) - surplus)
            surplus -= len(ids) - n
            if n:
                chosen.append((doc, ids[:n], start, loss_from))
            self.push(doc, ids[n:], start + n, loss_from)
        at = 0
        for doc, ids, start, _ in chosen:
            self.out.append((doc, start, ids, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def rows(self) -> pa.RecordBatch:
        (docs, start, ids, sequence, offset), self.out = zip(*self.out, strict=True), []
        return pa.record_batch([
            pa.array([d[0] for d in docs], pa.int64()), pa.array(start, pa.int64()),
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
            pa.array([d[1] for d in docs], pa.int64()), pa.array(sequence, pa.int64()),
            pa.array(offset, pa.int64())], schema=_SCHEMA)


def _pack(examples: Callable, tokens: int, segments: int, loss: int, lookahead: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, tokens, segments, loss, lookahead)
        for doc_id, ids, loss_from in examples(batches):
            packer.add((doc_id, len(ids)), ids, loss_from)
            if len(packer.out) >= 2000:
                yield packer.rows()
        while packer.docs:
            packer.close()
        if packer.out:
            yield packer.rows()

    return run


def _limits(max_tokens: int, max_segments: int, max_loss: int | None) -> tuple[int, int, int]:
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("every limit must be at least 1")
    return max_tokens, max_segments, max_loss


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                  max_loss: int | None = None, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Packs ``examples`` (doc_id, ids array<int>, loss_from): ids before position ``loss_from`` bear no loss.

    Null ids are an empty example and give no piece; a null ``loss_from`` is 0; null and repeated doc_ids are
    packed row by row; other columns are ignored. Returns PIECES: ``ids`` is the piece as little-endian 32-bit
    values, ``sequence_id`` is unique over all tasks, ``offset`` is the piece's place in its sequence.
    """

    def read(batches):
        for batch in batches:
            loss = batch.column("loss_from").to_pylist()
            for doc_id, ids, first in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), loss, strict=True):
                if ids.is_valid and len(ids):
                    yield doc_id, np.asarray(ids.values, dtype=np.uint32), first or 0

    used = examples.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids",
                               "cast(loss_from as long) loss_from")
    return used.mapInArrow(_pack(read, *_limits(max_tokens, max_segments, max_loss), lookahead), PIECES)


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 2, max_tokens: int = MAX_TOKENS,
                   max_segments: int = MAX_SEGMENTS, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Tokenizes and packs whole texts; every token bears loss, and ``end_id`` ends each document.

    The tokenizer must treat ASCII white space as a mere separator: words are tokenized one by one and remembered.
    A null or empty text is a document of ``end_id`` alone. Null and repeated doc_ids are packed row by row, an
    empty table gives no piece, other columns are ignored. Returns PIECES.
    """

    def read(batches):
        known = WordIds(tokenizer_file)
        for part in slices(batches, AT_A_TIME):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), known.texts(part.column("text")), strict=True):
                yield doc_id, np.append(ids, np.uint32(end_id)), 0

    used = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return used.mapInArrow(_pack(read, *_limits(max_tokens, max_segments, max_tokens), lookahead), PIECES)
