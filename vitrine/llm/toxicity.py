"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

Each word enters as a learnt word vector (words seen in MIN_DOCS training texts) beside the mean of its hashed
character n-gram vectors. Two GRUs read a window of WINDOW words in both directions, attention pools their states
into one logit. Windows overlap by WINDOW - STRIDE words and cover whole texts; a text's logit is the log-sum-exp
of its windows' logits, so one window is enough and the labels of texts can train windows.

Training runs in numpy on the driver, on at most SAMPLE texts and SAMPLE_BYTES of each class, whole texts as in scoring.
The vectors start with the log odds of their word or n-gram in the sample as first component. Scoring needs
only the weights (their size is bounded by the parameters below) and runs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import fingerprints, passed_on, slices, stored, words

WINDOW, STRIDE = 32, 24
WORD_DIMS = CHAR_DIMS = HIDDEN = 8
#: Texts of each class that are trained on, and their bytes.
SAMPLE, SAMPLE_BYTES = 1000, 2 << 20
#: Bytes of text whose words are counted at a time in training.
COUNTED = 256 << 10
MIN_DOCS, MAX_WORDS = 3, 30_000
CHAR_BUCKETS, CHAR_ORDERS = 1 << 15, (3, 4)
STEPS, BATCH, RATE = 120, 64, 0.01
#: Windows that pass through the network at a time.
TOGETHER = 4096
#: Bytes of text taken apart at a time.
AT_A_TIME = 3 << 20
EDGES = ".,;:!?\"'()[]{}<>*&%$#-_/\\"


def word_grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word between two marks, and where each word's begin."""
    size = np.fromiter((len(w) + 2 for w in distinct), np.int64, len(distinct))
    points = np.frombuffer("".join(f"^{w}$" for w in distinct).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(len(points))
    owner = np.repeat(np.arange(len(distinct)), size)
    grams, owners, key = [], [], np.zeros(len(points), np.uint32)
    spread = points * np.uint32(0x9E3779B1)
    for n in range(1, max(CHAR_ORDERS) + 1):
        key = (key ^ np.concatenate((spread[n - 1:], np.zeros(min(n - 1, len(spread)), np.uint32)))) * np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(15)
        if n in CHAR_ORDERS or n == 2:  # two marks alone: the empty word
            use = (room >= n) & ((n in CHAR_ORDERS) | (np.repeat(size, size) == 2))
            grams.append((key[use] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - CHAR_BUCKETS.bit_length() + 1))
            owners.append(owner[use])
    grams, owners = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.searchsorted(owners[order], np.arange(len(distinct) + 1))


class Texts:
    """Words of some texts and the windows over them, longest windows first."""

    def __init__(self, column: pa.Array):
        self.codes, self.offsets, distinct = words(pc.utf8_lower(pc.fill_null(column, "")))
        self.distinct = [w.strip(EDGES) or w for w in distinct]
        count = np.diff(self.offsets)
        windows = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, 1)
        self.text = np.repeat(np.arange(len(count)), windows)
        self.bounds = np.concatenate(([0], np.cumsum(windows)))
        start = (np.arange(len(self.text)) - np.repeat(self.bounds[:-1], windows)) * STRIDE
        self.size = np.minimum(count[self.text] - start, WINDOW)
        self.first = self.offsets[:-1][self.text] + start


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        inputs = WORD_DIMS + CHAR_DIMS

        def normal(*shape, by=0.1):
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.vocabulary = vocabulary
        self.w = {"word": normal(len(vocabulary) + 1, WORD_DIMS), "char": normal(CHAR_BUCKETS, CHAR_DIMS)}
        self.w["word"][-1] = 0  # of words that are not known
        for way in "fb":
            self.w["in_" + way] = normal(inputs, 3 * HIDDEN, by=0.3)
            self.w["rec_" + way] = normal(HIDDEN, 3 * HIDDEN, by=0.3)
            self.w["bias_" + way] = np.zeros(3 * HIDDEN, np.float32)
        self.w |= {"attend": normal(2 * HIDDEN), "out": normal(2 * HIDDEN, by=0.3), "bias": np.full(1, -2, np.float32)}

    def known(self, distinct: list[str]) -> np.ndarray:
        prints = fingerprints(distinct)
        at = np.searchsorted(self.vocabulary, prints)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == prints, at, len(self.vocabulary)) if len(self.vocabulary) else at

    def inputs(self, distinct: list[str]) -> tuple[np.ndarray, tuple]:
        word, (grams, bounds) = self.known(distinct), word_grams(distinct)
        n = np.diff(bounds)
        char = np.add.reduceat(self.w["char"][grams], bounds[:-1], axis=0) / np.sqrt(n)[:, None]
        return np.concatenate((self.w["word"][word], char.astype(np.float32)), 1), (word, grams, n)

    def _read(self, way: str, gates: np.ndarray, index: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each step; ``live[t]`` windows reach step t."""
        h = np.zeros((index.shape[1], HIDDEN), np.float32)
        out = np.zeros((len(index), index.shape[1], HIDDEN), np.float32)
        rec, two = self.w["rec_" + way], 2 * HIDDEN
        for t in range(len(index)) if way == "f" else range(len(index) - 1, -1, -1):
            n = live[t]
            x, before = gates[index[t, :n]], h[:n]
            past = before @ rec
            zr = _sigmoid(x[:, :two] + past[:, :two])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, two:] + r * past[:, two:])
            after = new + z * (before - new)
            if keep is not None:
                keep.append((t, n, z, r, new, before.copy(), past[:, two:]))
            h[:n] = out[t, :n] = after
        return out

    def forward(self, inputs: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray, keep: dict | None = None):
        """Logits of windows, which come longest first."""
        steps = int(size[0]) if len(size) else 0
        if not steps:
            return np.full(len(size), self.w["bias"][0], np.float32)
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        index = codes[np.minimum(first + np.arange(steps)[:, None], len(codes) - 1)]
        states = []
        for way in "fb":
            gates = inputs @ self.w["in_" + way] + self.w["bias_" + way]
            log = [] if keep is not None else None
            states.append(self._read(way, gates, index, live, log))
            if keep is not None:
                keep[way] = log
        h = np.concatenate(states, 2)
        energy = h @ self.w["attend"]
        energy[np.arange(steps)[:, None] >= size] = -1e9
        share = np.exp(energy - energy.max(0))
        share = share / share.sum(0) * (size > 0)
        pooled = np.einsum("tb,tbh->bh", share, h)
        if keep is not None:
            keep |= {"h": h, "share": share, "pooled": pooled, "index": index, "live": live}
        return pooled @ self.w["out"] + self.w["bias"][0]

    def backward(self, grad: np.ndarray, inputs: np.ndarray, parts: tuple, keep: dict) -> dict:
        """Gradients of all weights from those of the windows' logits."""
        w, g = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        if not keep:  # windows without words
            return g | {"bias": np.array([grad.sum()], np.float32)}
        h, share, pooled, index = keep["h"], keep["share"], keep["pooled"], keep["index"]
        g["out"], g["bias"] = pooled.T @ grad, np.array([grad.sum()], np.float32)
        value = h @ w["out"]
        energy = share * (value - (share * value).sum(0)) * grad
        dh = energy[:, :, None] * w["attend"] + (share * grad)[:, :, None] * w["out"]
        g["attend"] = np.einsum("tb,tbh->h", energy, h)
        d_inputs = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            own, rec, two = dh[:, :, k * HIDDEN:(k + 1) * HIDDEN], w["rec_" + way], 2 * HIDDEN
            carry, d_gates = np.zeros(own.shape[1:], np.float32), np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            for t, n, z, r, new, before, past in reversed(keep[way]):
                d = own[t, :n] + carry[:n]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * past * r * (1 - r)
                x = np.concatenate((d_z, d_r, d_new), 1)
                back = np.concatenate((d_z, d_r, d_new * r), 1)
                np.add.at(d_gates, index[t, :n], x)
                g["rec_" + way] += before.T @ back
                carry[:n] = d * z + back @ rec.T
            g["bias_" + way] = d_gates.sum(0)
            g["in_" + way] = inputs.T @ d_gates
            d_inputs += d_gates @ w["in_" + way].T
        word, grams, n = parts
        np.add.at(g["word"], word, d_inputs[:, :WORD_DIMS])
        g["word"][-1] = 0
        np.add.at(g["char"], grams, np.repeat(d_inputs[:, WORD_DIMS:] / np.sqrt(n)[:, None], n, axis=0))
        return g

    def logits(self, texts: Texts) -> np.ndarray:
        order = np.argsort(-texts.size, kind="stable")
        inputs, _ = self.inputs(texts.distinct) if texts.distinct else (np.zeros((0, WORD_DIMS + CHAR_DIMS)), None)
        out = np.empty(len(order), np.float32)
        for start in range(0, len(order), TOGETHER):
            some = order[start:start + TOGETHER]
            out[some] = self.forward(inputs, texts.codes, texts.first[some], texts.size[some])
        top = np.maximum.reduceat(out, texts.bounds[:-1])
        return top + np.log(np.add.reduceat(np.exp(out - top[texts.text]), texts.bounds[:-1]))

    def gradients(self, texts: Texts, labels: np.ndarray) -> dict:
        """Gradients of all weights from the mean loss of the texts; states of TOGETHER windows are kept at a time."""
        inputs, parts = self.inputs(texts.distinct)
        by_size = np.argsort(-texts.size, kind="stable")
        logit, keep = np.empty(len(by_size), np.float32), {}
        chunks = [by_size[i:i + TOGETHER] for i in range(0, len(by_size), TOGETHER)]
        for some in chunks:
            keep = {}
            logit[some] = self.forward(inputs, texts.codes, texts.first[some], texts.size[some],
                                       keep if len(chunks) == 1 else None)
        top = np.maximum.reduceat(logit, texts.bounds[:-1])
        share = np.exp(logit - top[texts.text])
        total = np.add.reduceat(share, texts.bounds[:-1])
        error = _sigmoid(top + np.log(total)) - labels
        grad = (share / total[texts.text] * error[texts.text] / len(labels)).astype(np.float32)
        if len(chunks) == 1:
            return self.backward(grad[by_size], inputs, parts, keep)
        out = {k: np.zeros_like(v) for k, v in self.w.items()}
        for some in chunks:
            keep = {}
            self.forward(inputs, texts.codes, texts.first[some], texts.size[some], keep)
            for k, g in self.backward(grad[some], inputs, parts, keep).items():
                out[k] += g
        return out


def _odds(yes: np.ndarray, no: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log odds of each feature by the numbers of toxic and other texts that have it, drawn to 0 for rare ones."""
    odds = np.log((yes + 1.5) / (labels.sum() + 3)) - np.log((no + 1.5) / ((1 - labels).sum() + 3))
    return np.clip(odds * np.minimum(1, (yes + no) / 6), -3, 3).astype(np.float32)


def _chunks(texts: pa.Array, size: int) -> Iterator[slice]:
    """Stretches of texts of ``size`` bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield slice(start, stop)
        start = stop


def _presence(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word fingerprints with the numbers of (other, toxic) texts that have each, and those of the n-grams.

    Goes through the texts COUNTED bytes at a time; what it keeps is one row for each distinct word.
    """
    found, counts = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    buckets = np.zeros((2, CHAR_BUCKETS), np.int64)
    for part in _chunks(texts, COUNTED):
        some, label = Texts(texts[part]), labels[part]
        if not some.distinct:
            continue
        owner = np.repeat(np.arange(len(label)), np.diff(some.offsets))
        pairs = np.unique(some.codes * len(label) + owner)
        word, owner = pairs // len(label), pairs % len(label)
        prints, same = np.unique(fingerprints(some.distinct), return_inverse=True)
        once = np.unique(same[word] * len(label) + owner)
        print_of, toxic = once // len(label), label[once % len(label)]
        both, at = np.unique(np.concatenate((found, prints)), return_inverse=True)
        merged = np.zeros((2, len(both)), np.int64)
        merged[:, at[:len(found)]] = counts
        for k in (0, 1):
            merged[k, at[len(found):]] += np.bincount(print_of[toxic == k], minlength=len(prints))
        found, counts = both, merged
        grams, bounds = word_grams(some.distinct)
        for text in np.unique(owner):
            own = word[owner == text]
            has = np.zeros(CHAR_BUCKETS, bool)
            for first in range(0, len(own), 4096):
                piece = own[first:first + 4096]
                n = np.diff(bounds)[piece]
                has[grams[np.repeat(bounds[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
            buckets[label[text]] += has
    return found, counts, buckets


def train(texts: pa.Array, labels: np.ndarray, steps: int = STEPS) -> Network | None:
    """A network trained on these texts; None if one of the two classes is missing."""
    labels = np.asarray(labels, np.int64)
    if not labels.any() or labels.all():
        return None
    found, counts, buckets = _presence(texts, labels)
    docs = counts.sum(0)
    chosen = np.sort(np.argsort(-docs, kind="stable")[:MAX_WORDS])
    chosen = chosen[docs[chosen] >= MIN_DOCS]
    net = Network(found[chosen])
    net.w["word"][:-1, 0] = _odds(counts[1, chosen], counts[0, chosen], labels)
    net.w["char"][:, 0] = _odds(buckets[1], buckets[0], labels)

    rng = np.random.default_rng(7)
    rounds = -(-steps * BATCH // len(labels))
    order = np.concatenate([rng.permutation(len(labels)) for _ in range(rounds)])
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = order[(step - 1) * BATCH:step * BATCH]
        t, y = Texts(texts.take(pa.array(some))), labels[some]
        if not t.distinct:
            continue
        for k, g in net.gradients(t, y).items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            net.w[k] -= RATE * mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Network | None:
    """Trained on at most ``sample`` texts of each class, the first by a hash of doc_id, and ``size`` bytes of each.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; rows with a null in either of these teach nothing,
    of several labels of a document the largest counts, of several texts the smallest. Texts are taken whole: one
    that no longer fits into the ``size`` bytes of its class is passed over.
    """
    marks = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").dropna().groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").dropna().distinct()
    marks = marks.join(ids, "doc_id").withColumn("order", F.xxhash64("doc_id"))
    chosen = [marks.where(F.col("toxic") == c).orderBy("order", "doc_id").limit(sample) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * sample ids
    fitting = docs.where(F.octet_length("text") <= size).select("doc_id", "text")
    rows = stored(fitting.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "order").agg(
        F.min("text").alias("text")), "labelled")
    left, taken = {0: size, 1: size}, []
    for row in rows.select("doc_id", "toxic", F.octet_length("text").alias("n")).orderBy("order", "doc_id").collect():
        if row["n"] <= left[row["toxic"]]:
            left[row["toxic"]] -= row["n"]
            taken.append(row["doc_id"])
    if not taken:
        return None
    texts = rows.where(F.col("doc_id").isin(taken)).orderBy("order", "doc_id").select("text", "toxic").toArrow()
    return train(texts["text"].combine_chunks().cast(pa.string()), texts["toxic"].to_numpy())


def score(docs: DataFrame, net: Network | None, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with score, the chance of the toxic label, and predicted (1 from 0.5 on).

    Whole texts are scored, whatever their length. A null or empty text is one window without words, whose score is
    the network's bias alone. Without a network (no labels of both classes) every score is 0.
    """
    used = docs.select(*keep, F.col("text").cast("string").alias("text"))
    if net is None:
        return used.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast((net.vocabulary, net.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(sent.value[0][:0])
        net.vocabulary, net.w = sent.value
        for part in slices(batches, AT_A_TIME):
            chance = _sigmoid(net.logits(Texts(part.column("text"))).astype(np.float64))
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(chance),
                                   pa.array((chance >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return used.mapInArrow(run, passed_on(used, keep, "score double, predicted int"))
