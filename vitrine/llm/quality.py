"""Quality by perplexity under an interpolated modified Kneser-Ney model of character 4-grams of trusted text.

A 4-gram is one 64-bit number, 16 bits for each character (its low 16 bits; 0 before the text begins), so contexts
and suffixes are shifts and masks in column expressions.

1. Documents are dealt once to groups of GROUP_BYTES of text. Each group counts the 4-grams of its trusted texts
   and lists the distinct 4-grams of all its texts.
2. Sharded by 4-gram: counts are added up, continuation counts and context sums of each lower order follow by
   aggregation, and the distinct 4-grams that are asked for get their interpolated probability by joins, order by
   order. Nothing of the model is broadcast but the three discounts of each order.
3. Each group gets the probabilities of its own 4-grams and adds them up by document.
4. A document is kept unless its perplexity exceeds MARGIN times the QUANTILE of the trusted documents of its
   language (of all trusted documents, where its language has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices, stored

ORDER = 4
BITS = 16
GROUP_BYTES = 24 << 20
QUANTILE, MARGIN = 0.99, 1.1
AT_A_TIME = 1 << 20


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character and the texts' bounds."""
    texts = pc.fill_null(texts, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = (points & 0xFFFF).astype(np.uint64)
    inside = np.arange(len(points)) - np.repeat(bounds[:-1], sizes)
    out = points.copy()
    for back in range(1, ORDER):
        earlier = np.concatenate((np.zeros(min(back, len(points)), np.uint64), points[:max(0, len(points) - back)]))
        out |= np.where(inside >= back, earlier, 0) << np.uint64(BITS * back)
    return out.view(np.int64), bounds


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def _survey(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Distinct 4-grams of a group, each with its count in trusted texts."""
    known, found = pa.array(trusted["doc_id"].to_pylist(), pa.int64()), []
    for part in slices(docs.to_batches(), AT_A_TIME):
        good = pc.is_in(part.column("doc_id"), value_set=known)
        for rows, weight in ((part.filter(good), 1), (part.filter(pc.invert(good)), 0)):
            keys, counts = np.unique(grams(rows.column("text"))[0], return_counts=True)
            found.append((keys, counts * weight))
        if len(found) > 40:
            found = [_merge(found)]
    keys, counts = _merge(found) if found else (np.empty(0, np.int64),) * 2
    # A group without documents (labels only) has no rows.
    grp = docs["grp"][0].as_py() if docs.num_rows else 0
    return pa.table({"grp": pa.array(np.full(len(keys), grp, np.int32)), "gram": keys, "n": counts})


def _add_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Number of characters and log-probability of each document of a group."""
    keys, logs = answers["gram"].to_numpy(), answers["logp"].to_numpy()
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order]
    out = []
    for part in slices(docs.to_batches(), AT_A_TIME):
        asked, bounds = grams(part.column("text"))
        distinct, at = np.unique(asked, return_inverse=True)
        sums = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(keys, distinct)][at])))
        out.append(pa.table({"doc_id": part.column("doc_id"), "lang": part.column("lang"),
                             "n_chars": np.diff(bounds), "logp": np.diff(sums[bounds])}))
    return pa.concat_tables(out) if out else pa.table({
        "doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()),
        "n_chars": pa.array([], pa.int64()), "logp": pa.array([], pa.float64())})


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of 1, 2 and more from the numbers of n-grams counted 1 to 4 times.

    Where a number is 0 the formula does not hold; the discount is then half the count's lower neighbour step.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else k - 0.5
        found.append(min(max(d, 0.05), k - 0.01))
    return tuple(found)


def _order(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (gram, n): discounted shares (gram, alpha) and what each context leaves (context, gamma)."""
    tally = counts.select(*(F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    one, two, more = discounts(*(x or 0.0 for x in tally))
    off = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
    parts = counts.select("gram", F.shiftrightunsigned("gram", BITS).alias("context"), "n", off.alias("off"))
    context = parts.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
    alpha = parts.join(context, "context").select("gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("alpha"))
    return alpha, context.select("context", (F.col("left") / F.col("total")).alias("gamma"))


def _suffix(order: int):
    return F.col("gram").bitwiseAND((1 << BITS * order) - 1)


def probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, logp): probability of each 4-gram's last character after the other three."""
    levels, current = {}, counts
    for k in range(ORDER, 0, -1):
        levels[k] = _order(current)
        if k > 1:  # in how many n-grams of the order above it is the end
            current = stored(current.select(_suffix(k - 1).alias("gram")).groupBy("gram").agg(
                F.count("*").alias("n")), "continuations")
    out = asked.select("gram", F.lit(2.0 ** -BITS).alias("p"))
    for k in range(1, ORDER + 1):
        alpha, gamma = levels[k]
        suffix = F.col("gram") if k == ORDER else _suffix(k)
        out = out.withColumn("s", suffix).withColumn("context", F.shiftrightunsigned("s", BITS))
        out = out.join(alpha.withColumnRenamed("gram", "s"), "s", "left").join(gamma, "context", "left")
        p = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")
        out = out.select("gram", p.alias("p"))
    return out.select("gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity of each row of ``docs`` (doc_id, text, lang) under ``trusted`` (doc_id).

    A null or empty text has 0 characters and a null perplexity. Without trusted text all characters are equally
    likely. Null and repeated doc_ids are scored row by row.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    # Rows without a doc_id are dealt by their text.
    dealt = rows.withColumn("grp", F.expr(f"cast(pmod(hash(coalesce(doc_id, xxhash64(text))), {groups}) as int)"))
    told = trusted.selectExpr("cast(doc_id as long) doc_id").dropna().distinct().withColumn(
        "grp", F.expr(f"cast(pmod(hash(doc_id), {groups}) as int)"))
    survey = stored(dealt.select("grp", "doc_id", "text").groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(
        _survey, "grp int, gram long, n long"), "grams")
    by_gram = stored(survey.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    answers = probabilities(by_gram.select("gram"), by_gram.where("n > 0"))
    told = survey.select("grp", "gram").join(stored(answers, "answers"), "gram")
    scores = dealt.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(
        _add_up, "doc_id long, lang string, n_chars long, logp double")
    return scores.select("doc_id", "lang", "n_chars",
                         F.when(F.col("n_chars") > 0, F.exp(-F.col("logp") / F.col("n_chars"))).alias("perplexity"))


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept for every row of ``docs``.

    Documents without text are not kept; without any trusted document there is no threshold and all others are.
    """
    scored = stored(perplexities(docs, trusted), "perplexities")
    ids = trusted.selectExpr("cast(doc_id as long) doc_id").dropna().distinct()
    good = scored.join(ids, "doc_id", "left_semi").where("perplexity is not null")
    cut = (F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("cut")
    by_lang = good.withColumn("lang", F.coalesce("lang", F.lit(""))).groupBy("lang").agg(cut)
    overall = good.agg(cut).first()[0]
    out = scored.join(by_lang.withColumnRenamed("lang", "l"), F.coalesce("lang", F.lit("")) == F.col("l"), "left")
    out = out.withColumn("threshold", F.coalesce("cut", F.lit(overall).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))
