"""Main text of web pages by minimum-cut labelling.

A page is a row of text blocks. A classifier gives each block's cost of being called boilerplate or content: these are
the capacities to the two terminals. Neighbors on the page are joined by edges that weigh more the fewer elements lie
between them, and so are the blocks that follow one another under the same element. The minimum cut pays the least for
labels against the classifier and for neighbors with different labels; what stays with the source is the main text.

The classifier has two parts. What the markup says (elements, roles, class names) has fixed weights. What the text says
(length, links, punctuation, kind of element) is a logistic regression, trained on the blocks of at most SAMPLE pages
whose markup leaves no doubt, drawn to the weights of PRIOR; without such pages PRIOR is the classifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import blocks as B
from vitrine.llm.common import passed_on, slices

#: Pages the text part is trained on, the first by a hash of the page, and blocks of each, the first by a hash.
SAMPLE, BLOCKS = 400, 64
#: Log odds of a block by its region, and of a block outside the article on a page that marks one.
INSIDE_WEIGHT, OUTSIDE_WEIGHT, ELSEWHERE = 5.0, -9.0, -4.0
#: The text part lies between -LIMIT and LIMIT, so that it cannot overrule both the markup and the neighbors.
LIMIT = 3.0
#: Weight of an edge between blocks with nothing between them, of one between siblings, and of one across regions.
NEXT, SIBLING, ACROSS = 2.0, 1.0, 0.25
#: Capacities are whole numbers of thousandths.
UNIT = 1000
FEATURES = ("one", "length", "linked", "marks", "paragraph", "heading", "entry", "cell")
#: Weights of FEATURES before training, how firmly the training is drawn to them, and what all its blocks together
#: weigh: pages of one make must not unlearn what holds for others.
PRIOR = np.array([-1.5, 0.55, -4.0, 0.8, 0.7, 0.8, -0.6, -0.8])
FIRMNESS, EVIDENCE = 20.0, 200.0
MARKS = str.maketrans("", "", ".,;:!?")


def features(page: list[B.Block]) -> np.ndarray:
    """One row of FEATURES for each block; nothing of them depends on the region."""
    out = np.empty((len(page), len(FEATURES)))
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        marks = len(b.text) - len(b.text.translate(MARKS))
        out[i] = (1, np.log1p(len(b.text)), min(b.linked / len(b.text), 1), min(marks / words * 4, 1), b.tag == "p",
                  b.tag in B.HEADING, b.tag in ("li", "dt", "dd"), b.tag in ("td", "th", "caption"))
    return out


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression drawn to PRIOR, by Newton's method."""
    w = PRIOR.copy()
    if not len(y) or y.all() or not y.any():
        return w
    share = EVIDENCE / 2 / np.where(y, y.sum(), (~y).sum())  # both classes count alike
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - FIRMNESS * (w - PRIOR)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + FIRMNESS * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def costs(page: list[B.Block], weights: np.ndarray) -> list[int]:
    """Log odds that each block is content, in UNITs."""
    text = np.clip(features(page) @ weights, -LIMIT, LIMIT)
    marked = any(b.region & B.ARTICLE and not b.region & B.OUTSIDE for b in page)
    out = []
    for b, t in zip(page, text.tolist(), strict=True):
        if b.region & B.OUTSIDE:
            t += OUTSIDE_WEIGHT
        elif b.region & B.ARTICLE:
            t += INSIDE_WEIGHT
        elif marked:
            t += ELSEWHERE
        out.append(round(t * UNIT))
    return out


def edges(page: list[B.Block]) -> list[tuple[int, int, int]]:
    """(block, earlier block, weight): each block with the one before and with the one before under its element."""
    out, last = [], {}
    for i, b in enumerate(page):
        def weight(j: int, full: float) -> int:
            return round(full * UNIT * (1 if page[j].region == b.region else ACROSS))

        if i:
            out.append((i, i - 1, weight(i - 1, NEXT / (1 + b.near / 4))))
        before = last.get(b.parent)
        if before is not None:
            out.append((i, before, weight(before, SIBLING)))
        last[b.parent] = i
    return [e for e in out if e[2] > 0]


def cut(terminal: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie with the source in the minimum cut with the fewest nodes there.

    ``terminal`` is the capacity from the source (positive) or to the sink (negative). A node whose terminal outweighs
    all its edges is decided at once, and its edges become its neighbors' terminals; the flow runs through the rest.
    """
    n = len(terminal)
    net = list(terminal)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in joined:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    around = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    waiting = list(range(n))
    while waiting:
        u = waiting.pop()
        if label[u] is not None or abs(net[u]) <= around[u]:
            continue
        label[u] = net[u] > 0
        for v, w in near[u].items():
            if label[v] is None:
                net[v] += w if label[u] else -w
                around[v] -= w
                waiting.append(v)
    left = [u for u in range(n) if label[u] is None]
    if left:
        kept = _flow([net[u] for u in left], [
            {v: w for v, w in near[u].items() if label[v] is None} for u in left], left)
        for u, side in zip(left, kept, strict=True):
            label[u] = side
    return [bool(x) for x in label]


def _flow(net: list[int], near: list[dict[int, int]], names: list[int]) -> list[bool]:
    """Maximum flow by blocking flows over shortest paths; True where the residual network is still reached."""
    place = {name: i for i, name in enumerate(names)}
    n = len(net)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for u in range(n):
        if net[u] > 0:
            add(source, u, net[u], 0)
        elif net[u] < 0:
            add(u, sink, -net[u], 0)
        for v, w in near[u].items():
            if place[v] > u:
                add(u, place[v], w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for u in queue:
            for e in head[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        nexts, path = [0] * (n + 2), []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[full] ^ 1]
                del path[full:]
            while nexts[u] < len(head[u]):
                e = head[u][nexts[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                nexts[u] += 1
            else:
                if u == source:
                    break
                u = to[path.pop() ^ 1]
                nexts[u] += 1


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    """The blocks of the main text, one on each line."""
    page = B.read(html or "")
    if not page:
        return ""
    keep = cut(costs(page, weights), edges(page))
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


# ---------------------------------------------------------------- on the plan


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of blocks whose markup leaves no doubt, of each different page of the task."""
    seen: set[int] = set()
    for part in slices(batches):
        for key, html in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
            if key in seen:
                continue
            seen.add(key)
            page = B.read(html)
            sure = [i for i, b in enumerate(page) if bool(b.region & B.ARTICLE) != bool(b.region & B.OUTSIDE)]
            sure = sorted(sure, key=lambda i: xxhash.xxh64_intdigest(f"{i} {page[i].text}"))[:BLOCKS]
            x = features([page[i] for i in sure])
            yield pa.record_batch(
                [pa.array([key] * len(sure), pa.int64()), pa.array(sure, pa.int32()), pa.array(list(x), pa.list_(
                    pa.float64())), pa.array([not page[i].region & B.OUTSIDE for i in sure], pa.bool_())],
                names=["key", "block", "x", "y"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the text part, from at most ``sample`` different pages (first by hash) and BLOCKS blocks of each."""
    keyed = pages.where("html is not null").select(F.xxhash64("html").alias("key"), F.col("html").alias("text"))
    last = keyed.select("key").distinct().orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if last is None:
        return PRIOR
    found = keyed.where(F.col("key") <= last).mapInArrow(_learn, "key long, block int, x array<double>, y boolean")
    rows = found.dropDuplicates(["key", "block"]).orderBy("key", "block").toArrow()  # sample * BLOCKS small rows
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return train(x, rows["y"].to_numpy(zero_copy_only=False).astype(bool))


def extract(pages: DataFrame, *keep: str, weights: np.ndarray | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` with text, the main text of html, and n_chars, its code points.

    A null or empty page, and one without main text, has an empty text. Every row is read whole and on its own, so
    repeated pages and ids have equal texts. Blocks that the cut may place on either side are left out.
    """
    used = pages.select(*keep, F.col("html").cast("string").alias("text"))
    chosen = fit(pages.select(F.col("html").cast("string").alias("html"))) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(html, chosen) for html in part.column("text").to_pylist()]
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return used.mapInArrow(run, passed_on(used, keep, "text string, n_chars long"))
