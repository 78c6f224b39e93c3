"""HTML extraction, whitening and collocations against plain versions, with nulls, long texts, repeats and odd columns."""

import collections
import itertools
import random
import re
import string

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import blocks, bytepair, itq, langid, mincut, stripes, toxicity, vafile, whitening

# ---------------------------------------------------------------- 11 main text

LONG = "This is a fairly long sentence of the main story, with commas, and it goes on for a while."


@pytest.mark.parametrize("html,want", [
    (f"<body><header><h1>Site</h1><p>Welcome to the site, where we say things, often and long.</p></header><main><h1>T</h1>"
     f"<p>{LONG}<p>Hi.<blockquote>Quote, she said.</blockquote><ul><li>one thing<li>two things</ul><table><tr><td>a<td>b</table>"
     f"<form><p>{LONG}<input></form><aside>{LONG}</aside><section class='comments'><p>{LONG}</p></section></main>"
     f"<footer><p>{LONG}</p></footer>", ["T", LONG, "Hi.", "Quote, she said.", "one thing", "two things", "a", "b"]),
    (f"<form id=page><nav><a>z</a></nav><article><header><h1>Head</h1></header><p>{LONG}</p></article></form>", ["Head", LONG]),
    (f"<div class='cookie-banner'><p>{LONG}</p></div><article><p>Tiny.</p></article><div id=comments><p>{LONG}</p></div>", ["Tiny."]),
    (f"<div class='page has-sidebar'><div class='post-body'><p>{LONG}</p><p>ok</p></div><div class=widget><p>{LONG}</p></div></div>",
     [LONG, "ok"]),
    (f"<div id=top><a href=/>Home</a> | <a href=/x>News</a></div><div><h1>Title</h1><div>{LONG}</div><div>Short.</div>"
     f"<div>{LONG} {LONG}</div></div><div class='sidebar'><p>{LONG}</p></div>", ["Title", LONG, "Short.", f"{LONG} {LONG}"]),
    ("<article><p>AT&amp;T &lt;b&gt; &eacute;&#233;&#xE9; a < b &am <b>bo<i>ld</i></b>ly<br>next&nbsp;&nbsp;x\n\t y</p>"
     f"<p title='a>b'>{LONG}</p><script>if (a</b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>end <a hr",
     ["AT&T <b> ééé a < b &am boldly next x y", LONG, "end"]),
])
def test_main_text(html, want):
    assert mincut.main_text(html).split("\n") == want


def test_cut_is_a_minimum_cut():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8)
        terminal = [rng.randint(-6, 6) for _ in range(n)]
        joined = [(i, j, rng.randint(1, 4)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        costs = []
        for labels in itertools.product((0, 1), repeat=n):
            cost = sum(abs(t) for t, x in zip(terminal, labels) if (t > 0) != bool(x) and t)
            costs.append((cost + sum(w for a, b, w in joined if labels[a] != labels[b]), sum(labels), labels))
        assert tuple(mincut.cut(terminal, joined)) == tuple(bool(x) for x in min(costs)[2])


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<p>a" * 20_000, "<a '" * 50_000, "<" * 50_000, "<!--" * 50_000, "</p>" * 20_000])
def test_long_broken_pages_end_soon(html):
    assert isinstance(mincut.main_text(html), str)


def test_pages_of_all_kinds(spark):
    page = f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LONG}</p></article><footer>&copy; us</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<nav>menu</nav>"), (None, "x", page * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("text", "n_chars", "key", "block")})
    got = mincut.extract(df, "page_id", "url").collect()
    text = f"Head\n{LONG}"
    want = [(1, "u", text), (1, "u", text), (2, None, ""), (3, "v", ""), (4, "w", ""), (None, "x", "\n".join([text] * 3000))]
    assert sorted(map(repr, ((r.page_id, r.url, r.text) for r in got))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in got)
    assert mincut.extract(df.limit(0), "page_id").count() == 0


def test_training_follows_its_pages_but_keeps_what_it_knew():
    x = mincut.features(blocks.read(f"<p>{LONG}</p><li><a>link</a></li><div>{LONG}</div>"))
    y = np.array([True, False, True])
    w = mincut.train(np.tile(x, (50, 1)), np.tile(y, 50))
    assert ((x @ w > 0) == y).all() and abs(w - mincut.PRIOR).max() < 2
    assert (mincut.train(x[:0], y[:0]) == mincut.PRIOR).all() and (mincut.train(x, y | True) == mincut.PRIOR).all()


# ---------------------------------------------------------------- 3 long words without a folder to spill to


def test_a_long_unbroken_word_is_encoded_within_memory(tmp_path, monkeypatch):
    import public_tokenizers
    import tiktoken

    monkeypatch.chdir(tmp_path)
    ranks = bytepair.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = bytepair.Encoder(ranks, bytepair.merge_table(ranks), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1500, 30, 1100)] + ["ab" * 3000, "short"]
    size, ids = encoder.contract(words)
    bounds = np.concatenate(([0], np.cumsum(size)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode_ordinary(w) for w in words]
    assert not list(tmp_path.iterdir())


def test_contraction_stores_only_the_last_round_of_a_word():
    """Rounds of many words of many merges together would not fit into the memory of a query."""
    import public_tokenizers
    import tiktoken

    ranks = bytepair.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = bytepair.Encoder(ranks, bytepair.merge_table(ranks), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(1000)) for _ in range(200)] + ["aa" * n + "b" for n in range(1, 60)]
    encoder.base.execute("SET memory_limit = '40MB'").fetchall()
    size, ids = encoder.contract(words)
    bounds = np.concatenate(([0], np.cumsum(size)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode_ordinary(w) for w in words]


def test_every_id_has_a_character_of_its_own():
    rows = pa.table({"tokens": [bytepair._characters(np.arange(bytepair.END_CHAR - bytepair.FIRST_CHAR, dtype=np.int32))]})
    base = bytepair._database()
    base.register("symbols", rows)
    got = base.execute("SELECT string_split(tokens, '') FROM symbols").fetchall()[0][0]
    assert got == list(rows["tokens"][0].as_py())
    with pytest.raises(ValueError, match="more ids than characters"):
        bytepair.Encoder({b"a": bytepair.END_CHAR}, np.empty((0, 3), np.int32), ".")


# ---------------------------------------------------------------- 8 and 9 with very small and very large components


def test_links_of_vectors_whose_norms_leave_the_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, rng.normal(size=3).tolist()) for i in range(40)]
    tiny = {100: 1e-200, 101: 1e200, 102: 5e-324, 103: 1.0}
    rows += [(i, 0, [s, s, 0.0]) for i, s in tiny.items()]
    got = {r.vec_id: r for r in itq.linked_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    unit = np.array([np.array(v) / abs(max(v, key=abs)) for _, _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    cosine = unit @ unit.T >= 0.98
    assert all(got[i].component_id == 100 for i in tiny if not cosine[40:, :40].any())
    assert [got[i].n_links for i in tiny] == [int(cosine[40 + n].sum()) - 1 for n in range(4)]


def test_scores_of_large_components_are_exact(spark):
    vectors = {20: [3e7 + 1 / 64, 1.0], 1: [3e7 + 3 / 64, 2.0], 2: [-3e7, 5.0], 3: [2.5, 7.0], 40: [3e7 + 5 / 64, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items()}
    want = []
    for q in (20, 40):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    got = vafile.top_inner_products(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


# ---------------------------------------------------------------- 12 whitening


@pytest.mark.parametrize("kind", ["full", "rank", "graded", "equal", "one", "zero", "close"])
def test_components_are_eigenvectors(kind):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = {"full": rng.random(40) + 0.1, "rank": np.r_[rng.random(10), np.zeros(30)], "graded": 10.0 ** -np.arange(40),
              "equal": np.r_[np.full(15, 5.0), np.full(25, 1.0)], "one": np.ones(40), "zero": np.zeros(40),
              "close": 1 + 1e-9 * rng.normal(size=40)}[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.components(a)
    scale = max(abs(values).max(), 1e-300)
    assert abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale
    assert abs(vectors.T @ vectors - np.eye(40)).max() < 1e-13 and abs(a @ vectors - vectors * found).max() <= 1e-13 * scale


def plain_whitening(m, top):
    x = np.floor(64 * np.asarray(m, float)).astype(object) + 1_000_000
    n, s = len(x), x.sum(0)
    away = np.array([[(n * a - b) for a, b in zip(r, s)] for r in x], dtype=object)
    c = (away / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    return c @ v / np.sqrt(e), [sum(int(a) ** 2 for a in r) for r in away], e / np.trace(c.T @ c / n)


def test_whitening_equals_a_plain_version(spark):
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(300, 6)) * [3, 2, 1, 1, 0.5, 0.2]).tolist() + [[1e6, -3.0, 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(m)] + [
        (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0])]
    rows += [(3, m[3]), (None, m[4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("z", F.lit(1)).withColumn("n", F.lit(2))
    got = whitening.whiten(df, top=4).collect()
    z, deviation, share = plain_whitening(m + [m[3], m[4]], 4)
    assert len(got) == 303 * 4 and {r.n for r in got} == {303} and max(r.identity_error for r in got) < 1e-6
    for k in range(4):
        own = sorted((r.vec_id if r.vec_id is not None else 1000, r.whitened) for r in got if r.component == k + 1)
        want = sorted(zip([*range(301), 3, 1000], z[:, k]))
        assert np.allclose(np.abs([x for _, x in own]), np.abs([x for _, x in want]), rtol=1e-5, atol=1e-7)
        assert {round(r.explained, 11) for r in got if r.component == k + 1} == {round(float(share[k]), 11)}
    by_id = {r.vec_id: r.deviation for r in got}
    assert all(by_id[i] == (d if d < 1 << 63 else None) for i, d in enumerate(deviation[:301]))


def test_whitening_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.component, r.whitened, r.deviation, r.explained, r.identity_error) for r in whitening.whiten(df).collect()} == {
        (i, c, 0.0, 0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    assert whitening.whiten(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(huge).collect()


def test_deviation_beyond_a_long_is_null():
    x = np.array([[0, 0], [1 << 40, 5]], np.int64)
    centre = whitening.Centre(2, [1 << 40, 5])
    assert centre.deviation(x).to_pylist() == [None, None]
    small = whitening.Centre(2, [1 << 31, 0])
    assert small.deviation(np.array([[0, 0], [1 << 31, 0]], np.int64)).to_pylist() == [1 << 62, 1 << 62]


# ---------------------------------------------------------------- 13 collocations


def plain_collocations(rows, top):
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= 10}
    for (lang, p), a in candidates.items():
        longer = [n for (other, q), n in candidates.items() if other == lang and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])]
        if any(100 * n >= 50 * a for n in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0])
                  for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def phrases(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "İ", "a" * 3000]
    weights = [1 / (i + 1) for i in range(len(words))]
    def some(n):
        return "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " "]) for w in rng.choices(words, weights, k=n))

    rows = [(some(rng.randint(0, 120)) + rng.choice(["", "New York City", "new YORK city is"]), rng.choice(["en", "de", None, "und"]))
            for _ in range(150)]
    return rows + [(None, "en"), ("", None), ("x " * 60, "tie"), ("y z y z. " * 30, "tie"), (some(20_000), "long")] + rows[:5]


@pytest.mark.parametrize("size,hot", [(6 << 20, 1000), (300, 3)])
def test_collocations_equal_a_plain_version(spark, monkeypatch, size, hot):
    monkeypatch.setattr(stripes, "AT_A_TIME", size)
    monkeypatch.setattr(stripes, "HOT", hot)
    rows = phrases()
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("next", "prefix", "n", "phrase")})
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
                 for r in stripes.collocations(df, top=40).collect())
    assert got == plain_collocations(rows, 40) and len(got) > 60


def test_collocations_sql_equals_a_plain_version():
    rows = phrases(9)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    result = con.execute(stripes.duckdb_sql())
    names = [d[0] for d in result.description]
    got = sorted(tuple(dict(zip(names, r))[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in result.fetchall())
    assert got == plain_collocations(rows, 2000)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert stripes.collocations(df).count() == 0 and stripes.collocations(df.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_017, 3_000_000_019, 999_999_999_989
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(stripes._score("l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (l * r)


# ---------------------------------------------------------------- 2 and 5 against plain versions


def plain_logit(net, text):
    """The network one window, direction and word at a time."""
    t = toxicity.Texts(pa.array([text]))
    inputs = net.inputs(t.distinct)[0].astype(np.float64) if t.distinct else np.zeros((0, 16))
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    logits = []
    for first, size in zip(t.first, t.size):
        words_ = t.codes[first:first + size]
        states = []
        for way in "fb":
            h, out = np.zeros(toxicity.HIDDEN), []
            for code in words_ if way == "f" else words_[::-1]:
                x, past = inputs[code] @ w["in_" + way] + w["bias_" + way], h @ w["rec_" + way]
                z, r = (1 / (1 + np.exp(-(x[s] + past[s]))) for s in (slice(0, 8), slice(8, 16)))
                h = (1 - z) * np.tanh(x[16:] + r * past[16:]) + z * h
                out.append(h)
            states.append(out if way == "f" else out[::-1])
        if not len(words_):
            logits.append(w["bias"][0])
            continue
        both = np.concatenate(states, 1)
        share = np.exp(both @ w["attend"])
        logits.append(share / share.sum() @ both @ w["out"] + w["bias"][0])
    return np.log(np.exp(logits).sum())


def test_toxicity_scores_equal_a_plain_forward_pass():
    rng = random.Random(7)
    net = toxicity.Network(np.sort(toxicity.fingerprints(["w1", "w2", "w3"])), seed=3)
    for k in net.w:
        net.w[k] = (net.w[k] * 3).astype(np.float32)
    texts = ["", " \n", "w1", "w1, W2! unknown"] + [" ".join(f"w{rng.randint(0, 30)}" for _ in range(n)) for n in (5, 31, 32, 33, 56, 57, 200)]
    got = net.logits(toxicity.Texts(pa.array(texts)))
    assert np.allclose(got, [plain_logit(net, t) for t in texts], atol=1e-3)


def test_language_id_equals_a_plain_naive_bayes(spark):
    rng = random.Random(4)
    letters = {"aa": "abcde fg", "bb": "abxyz éü", "cc": "mnop qrs"}
    def text(lang, n):
        return "".join(rng.choice(letters[lang]) for _ in range(n))

    rows = [(text(lang, rng.randint(1, 60)), lang) for lang in letters for _ in range(25)] + [(None, "aa"), ("abc", None), ("", "bb")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = [text(lang, n) for lang in letters for n in (1, 4, 9)] + ["", None, "123 !", "Abc É", "aXm"]
    got = {r.i: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(
        list(enumerate(asked)), "i long, text string"), model, "i").collect()}

    def grams(value):
        return [int(b) for g in langid.hashed_grams(pa.array([value]))[0] for b in g if b >= 0]

    seen = {lang: collections.Counter() for lang in letters}
    for value, lang in rows:
        if value is not None and lang is not None:
            seen[lang].update(grams(value))
    for i, value in enumerate(asked):
        if value is None or not any(c.isalpha() for c in value):
            assert got[i] == ("und", 0.0)
            continue
        logs = {lang: sum(np.log((n[b] + langid.SMOOTHING) / (sum(n.values()) + langid.SMOOTHING * langid.BUCKETS)) for b in grams(value))
                for lang, n in seen.items()}
        best = max(sorted(logs), key=logs.get)
        chance = 1 / sum(np.exp(x - logs[best]) for x in logs.values())
        assert got[i][0] == best and abs(got[i][1] - chance) < 1e-3


def test_ties_between_languages_go_to_the_first(spark):
    model = langid.fit(spark.createDataFrame([("abc", "zz"), ("abc", "mm")], "text string, lang string"))
    row = langid.predict(spark.createDataFrame([("cab",)], "text string"), model).first()
    assert (row.lang_pred, row.score) == ("mm", 0.5)
