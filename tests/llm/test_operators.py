"""Every operator against a plain version, with nulls, empty and long texts, repeats, empty tables and odd columns."""

import collections
import json
import pathlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vitrine.llm import (
    bytepair, components, hyperminhash, itq, langid, licenses, packing, quality, substrings, toxicity, vafile,
)
from vitrine.llm.common import Runs, part_of
from vitrine.session import BATCH_BYTES, prepare

SYLLABLES = "ba ke di lo mu ra si to ne pa vu go".split()
CLASHES = ("ids", "row_key", "score", "anchor", "node", "component", "gram", "row", "text_a", "kept")


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows, lang=None):
    """doc_id and text beside columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string" + (", lang string" if lang else ""))
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def corpus(seed=4, n=60):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 220))) for i in range(n)]
    passage = prose(rng, 75)
    for i in (3, 9, 27, 40):
        rows[i] = (i, f"{prose(rng, 30)}\n{passage} {prose(rng, 20)}")
    for i in (11, 12, 13):
        rows[i] = (i, rows[10][1])
    changed = rows[20][1].split()
    rows[20] = (20, " ".join(changed + prose(rng, 120).split()))
    for i in (21, 22, 23):
        words = rows[i - 1][1].split()
        words[rng.randrange(len(words))] = "other"
        rows[i] = (i, "  ".join(words))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one two"), (n + 4, "One TWO"), (n + 5, "é" * 30_000),
             (n + 6, prose(rng, 6000)), (None, passage), (5, rows[5][1])]
    return rows


def words(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- shared


def test_run_fingerprints_depend_on_values_only():
    h = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    h[300:340] = h[100:140]
    at = Runs(h)
    one = at.of(np.array([100, 100, 105]), np.array([140, 139, 140]))
    two = at.of(np.array([300, 300, 305]), np.array([340, 339, 340]))
    assert (one == two).all() and len(set(one.tolist())) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# ---------------------------------------------------------------- 1 licences


def test_license_scan(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
           "included in all copies or\nsubstantial portions of the Software.")
    rows = [(1, f"x y.\n# Licensed under the Apache License, Version 2.0.\nmore"), (2, mit), (3, None), (4, ""),
            (5, "Licensed under CC BY-NC 4.0. Released under the MIT License."), (None, "Released under the MIT License."),
            (6, "licence to thrill"), (7, "a " * 50_000 + ".\nCopyright, all rights reserved.\n"),
            (5, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    got = collections.Counter(tuple(r) for r in licenses.scan(frame(spark, rows)).collect())
    assert got[(1, 1, "apache2_ref", "Apache-2.0", "")] == 1
    assert got[(2, 1, "mit_grant", "MIT", "")] == 1
    assert got[(3, 0, "", "", "")] == got[(4, 0, "", "", "")] == got[(6, 0, "", "", "")] == 1
    assert got[(5, 2, "cc_by_nc_ref,mit_ref", "CC-BY-NC-4.0,MIT", "")] == 2
    assert got[(None, 1, "mit_ref", "MIT", "")] == 1 and got[(7, 1, "reserved", "", "reserved")] == 1
    assert licenses.scan(frame(spark, [])).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert collections.Counter(con.execute(licenses.duckdb_sql()).fetchall()) == got


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
BSD_3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."""
CANONICAL = [
    (APACHE, "apache2_header,apache2_copy,apache2_as_is", "Apache-2.0"),
    (GPL.format(";", ";", 2), "gpl2_later,gnu_no_warranty", "GPL-2.0-or-later"),
    (GPL.format(":", ",", 3), "gpl3_later,gnu_no_warranty", "GPL-3.0-or-later"),
    (BSD, "bsd_grant,bsd_source,bsd_binary", "BSD-2-Clause"),
    (BSD_3, "bsd_grant,bsd_source,bsd_binary,bsd_endorse", "BSD-3-Clause"),
    (MIT, "mit_grant,mit_as_is", "MIT"),
    (MPL, "mpl2_ref", "MPL-2.0"),
]


def test_license_scan_finds_canonical_texts(spark):
    """As they are, with comment marks, with \\r\\n, on one line for each paragraph, with other list marks."""
    def shapes(text):
        yield text
        yield from ("\n".join((mark + " " + line).rstrip() for line in text.split("\n")) for mark in ("#", "//", " *", ";;", "--"))
        yield text.replace("\n", "\r\n")
        yield "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        yield " ".join(text.split())
        yield from (text.replace("1. ", a).replace("2. R", b + "R").replace("3. ", c)
                    for a, b, c in (("* ", "* ", "* "), ("(1) ", "(2) ", "(3) "), ("a) ", "b) ", "c) ")))

    want = [(ids, name) for text, ids, name in CANONICAL for _ in shapes(text)]
    rows = [(i, f"Copyright 2020 Somebody\n\n{t}") for i, t in enumerate(s for text, _, _ in CANONICAL for s in shapes(text))]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(frame(spark, rows)).collect()}
    wrong = [(rows[i][1], got[i], w) for i, w in enumerate(want) if got[i] != w]
    assert not wrong, wrong[0]


def test_license_scan_keeps_wrapped_and_unwrapped_sentences(spark):
    rows = [(1, "A note.\nReleased under the MIT License\nfoo bar.\nThis work is licensed under the GNU General Public\n"
                "License, version 3."),
            (2, f"{GPL.format(';', ';', 2)}\nReleased under the MIT License\n{BSD}\nLicensed under CC BY\n4.0"),
            (3, "Licensed under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except in\n"
                "compliance with the License.\nLicensed under the Apache License, Version 2.0\nand more")]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.unmatched) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {
        1: ("mit_ref,gpl3_ref", "GPL-3.0-only,MIT", ""),
        2: ("gpl2_later,gnu_no_warranty,mit_ref,bsd_grant,bsd_source,bsd_binary,cc_by_ref",
            "BSD-2-Clause,CC-BY-4.0,GPL-2.0-or-later,MIT", ""),
        3: ("apache2_header,apache2_ref", "Apache-2.0", "")}


def test_license_scan_reads_wrapped_dedications(spark):
    gaps = (" ", "\n", "  ", "\r\n", "\n# ", "\n * ", "\t")
    rows = [(i, f"Notes.\nThis work is dedicated to the public{gap}domain.\nMore.") for i, gap in enumerate(gaps)]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {i: ("cc0_ref", "CC0-1.0") for i in range(len(gaps))}


# ---------------------------------------------------------------- 2 toxicity


def test_toxicity_learns_words_and_parts_of_words(spark):
    rng = random.Random(2)
    bad = ["scurvish", "zorblat"]

    def text(toxic):
        ws = prose(rng, rng.randint(20, 90)).split()
        for _ in range(3 if toxic else 0):
            ws[rng.randrange(len(ws))] = rng.choice(bad) + rng.choice(["", "ka", "ti"])
        return " ".join(ws)

    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (301, None)], "doc_id long, toxic int")
    extra = [(1000, None), (1001, ""), (1002, prose(rng, 8000) + " zorblat scurvish zorblat"), (None, "a b"), (399, rows[399][1])]
    docs = frame(spark, rows + extra)
    net = toxicity.fit(docs, labels)
    got = collections.defaultdict(list)
    for r in toxicity.score(docs, net, "doc_id").collect():
        got[r["doc_id"]].append((r["score"], r["predicted"]))
    held = [(got[i][0][1], int(i % 4 == 0)) for i in range(300, 399)]
    assert sum(p == y for p, y in held) >= 95
    assert got[1002][0][1] == 1, "one window of a long text is enough"
    assert got[1000] == got[1001] and got[1000][0][1] == 0 and len(got[399]) == 2
    assert got[399][0] == pytest.approx(got[399][1], rel=1e-4)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for v in got.values() for s, p in v)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {tuple(r) for r in toxicity.score(docs, None, "doc_id").select("score", "predicted").collect()} == {(0.0, 0)}
    assert toxicity.score(frame(spark, []), net, "doc_id").count() == 0


def test_toxicity_trains_on_whole_texts(spark):
    """Toxic words after 9,000 characters only, which are all there is to learn."""
    rng = random.Random(8)
    filler = ["".join(rng.choice(SYLLABLES) for _ in range(40)) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(filler, k=130) + (["zorblat", "scurvish"] if i % 2 else []) + rng.choices(filler, k=5)))
            for i in range(120)]
    assert all(not i % 2 or t.index("zorblat") > 9_000 for i, t in rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    net = toxicity.fit(frame(spark, rows), labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, rows[80:]), net, "doc_id").collect()}
    assert got == {i: i % 2 for i in range(80, 120)}


def test_toxicity_gradients_of_a_few_windows_at_a_time(monkeypatch):
    texts = toxicity.Texts(pa.array(["a b c d e f g h " * 30, "x y z stupid q", "", "a stupid", None]))
    net = toxicity.Network(np.sort(toxicity.fingerprints(["a", "b", "stupid"])))
    labels = np.array([0, 1, 0, 1, 0])
    whole = net.gradients(texts, labels)
    monkeypatch.setattr(toxicity, "TOGETHER", 2)
    few = net.gradients(texts, labels)
    assert all(np.allclose(few[k], g, rtol=1e-4, atol=1e-7) for k, g in whole.items())


def test_toxicity_gradients():
    t = toxicity.Texts(pa.array(["a b c d e f g h " * 9, "x y z stupid q", "", "a stupid"]))
    net = toxicity.Network(np.sort(toxicity.fingerprints(["a", "b", "stupid"])))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    order = np.argsort(-t.size, kind="stable")
    weight = np.random.default_rng(0).standard_normal(len(order))

    def loss(keep=None):
        inputs, parts = net.inputs(t.distinct)
        out = net.forward(inputs.astype(np.float64), t.codes, t.first[order], t.size[order], keep)
        return (out * weight).sum(), inputs.astype(np.float64), parts

    keep = {}
    _, inputs, parts = loss(keep)
    grads = net.backward(weight, inputs, parts, keep)
    for name, w in net.w.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        w[at] += 1e-3
        high = loss()[0]
        w[at] -= 2e-3
        assert (high - loss()[0]) / 2e-3 == pytest.approx(grads[name][at], rel=1e-3, abs=1e-5)
        w[at] += 1e-3


# ---------------------------------------------------------------- 3 byte-level BPE


def test_bpe_equals_the_library(spark):
    ranks = bytepair.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", " \n", "\x1c", "\x85", " ", "a", "b's", "'s", "the", "é", "日本", "12", "½", "!",
             "...", "\x00", "<|endoftext|>", "👍", " x", " ", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    rows = list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, "a" * 5000 + "=-" * 400), (None, "x"), (9003, prose(rng, 9000)), (7, texts[7])]
    encoded = bytepair.encode(frame(spark, rows).repartition(3), ranks, public_tokenizers.PATTERN, "doc_id").cache()
    want = collections.Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    back = bytepair.decode(encoded, ranks, "doc_id").collect()
    assert collections.Counter((r["doc_id"], bytes(r["bytes"])) for r in back) == collections.Counter(
        (i, (t or "").encode()) for i, t in rows)
    assert bytepair.encode(frame(spark, []), ranks, public_tokenizers.PATTERN, "doc_id").count() == 0


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r" ?[a-z.]+| ?[^a-z. ]+| "])
def test_words_of_letters_need_no_pattern(pattern):
    """Distinct words of letters are cut in Arrow where the pattern is known, with or without a mark; others as the pattern says."""
    ranks = bytepair.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder, rng, seen = bytepair.Encoder(ranks, bytepair.merge_table(ranks), pattern), bytepair.Decoder(ranks), random.Random(5), []
    find = encoder.find
    encoder.find = lambda text: seen.append(text) or find(text)
    letters = "abcXYZ" + "".join(c for c in map(chr, range(0xc0, 0x100)) if c.isalpha())
    plain = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ","]) for _ in range(900)]
    odd = ["×a", "a÷", "ªº", "µ", "a..", ".", ",", "a.,", "e\u0301.", "don't", "'s.", "ŉ,", "1a.", "", "日é."]
    texts = [" ".join(plain), "", " ".join(odd + plain[:9]), " ".join(rng.sample(plain + odd, 300)), plain[0], " " + plain[1], "."]
    for some in (texts, texts[::-1]):
        bounds, ids = encoder.encode(pa.array(some))
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [library.encode_ordinary(t) for t in some]
        assert decoder.decode(ids, np.diff(bounds)).to_pylist() == [t.encode() for t in some]
    if pattern == public_tokenizers.PATTERN:
        assert not {f"{gap}{w}" for w in plain for gap in ("", " ")} & set(seen)
    assert decoder.decode(np.empty(0, np.int32), np.zeros(2, np.int64)).to_pylist() == [b"", b""]


# ---------------------------------------------------------------- 4 quality


def plain_kneser_ney(trusted, text):
    """Log-probability of a text by dictionaries."""
    order, counts = quality.ORDER, collections.Counter()
    for t in trusted:
        padded = "\0" * (order - 1) + t
        counts.update(padded[i:i + order] for i in range(len(t)))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    cut = {k: quality.discounts(*(sum(n == j for n in c.values()) for j in (1, 2, 3, 4))) for k, c in levels.items()}
    totals = {k: collections.Counter() for k in levels}
    left = {k: collections.Counter() for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            totals[k][g[:-1]] += n
            left[k][g[:-1]] += cut[k][min(n, 3) - 1]
    padded, out = "\0" * (order - 1) + text, 0.0
    for i in range(len(text)):
        p = 2.0 ** -quality.BITS
        for k in range(1, order + 1):
            g = padded[i + order - k:i + order]
            if h := totals[k][g[:-1]]:
                n = levels[k][g]
                p = (n - cut[k][min(n, 3) - 1] if n else 0) / h + left[k][g[:-1]] / h * p
        out += np.log(p)
    return out


def test_quality_equals_plain_kneser_ney(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(3, 60)), "aa" if i % 3 else None) for i in range(40)]
    rows += [(50, None, "aa"), (51, "", "aa"), (52, "§§ %% && ## §§ %%", "bb"), (None, "ba ke", "aa"), (3, rows[3][1], "aa"), (53, "日本" * 4000, "cc")]
    trusted = list(range(0, 30)) + [None, 99]
    docs, good = frame(spark, rows, lang=True), spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    texts = [t for i, t, _ in rows if i is not None and i < 30]
    got = collections.defaultdict(list)
    for r in quality.judge(docs, good).collect():
        got[r["doc_id"]].append(r)
    for i, t, _ in rows:
        if t:
            assert got[i][0]["perplexity"] == pytest.approx(np.exp(-plain_kneser_ney(texts, t) / len(t)), rel=1e-9)
    assert got[50][0]["perplexity"] is None and not got[50][0]["kept"] and not got[51][0]["kept"]
    assert not got[52][0]["kept"] and not got[53][0]["kept"] and got[5][0]["kept"] and len(got[3]) == 2
    free = quality.judge(docs, good.limit(0)).where("doc_id = 5").first()
    assert free["threshold"] is None and free["kept"] and free["perplexity"] == pytest.approx(2.0 ** quality.BITS)
    assert quality.judge(frame(spark, [], lang=True), good).count() == 0


# ---------------------------------------------------------------- 5 language


def test_language_id(spark):
    rng = random.Random(8)
    own = {"aa": SYLLABLES[:6], "bb": SYLLABLES[6:]}

    def text(lang):
        return " ".join("".join(rng.choice(own[lang]) for _ in range(3)) for _ in range(30))

    rows = [(i, text(lang), lang) for i in range(80) for lang in ("aa" if i % 2 else "bb",)]
    odd = [(100, None, None), (101, "", "aa"), (102, "12 34 !!", "aa"), (103, text("aa") * 300, None), (None, text("bb"), None), (1, rows[1][1], "aa")]
    docs = frame(spark, rows + odd, lang=True)
    model = langid.fit(docs.where(part_of("doc_id", 4) != 2))
    assert model[0] == ["aa", "bb"]
    got = collections.defaultdict(list)
    for r in langid.predict(docs, model, "doc_id").collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i][0][0] == ("aa" if i % 2 else "bb") for i in range(80))
    assert got[100] == got[101] == got[102] == [("und", 0.0)] and got[103][0][0] == "aa" and got[None][0][0] == "bb"
    assert len(got[1]) == 2 and all(0 <= s <= 1 for v in got.values() for _, s in v)
    nothing = langid.fit(frame(spark, [], lang=True))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, "doc_id").collect()} == {"und"}
    assert langid.predict(frame(spark, [], lang=True), model, "doc_id").count() == 0


# ---------------------------------------------------------------- 6 substrings


def plain_repeats(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[s:s + width])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[s:s + width])] < i:
                gone[s:s + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("width, k", [(50, 15), (8, 3), (5, 5)])
def test_repeats_equal_plain_windows(spark, width, k):
    rows = corpus()
    rng = random.Random(5)
    rows += [(200 + i, " ".join(rng.choice("ab") for _ in range(60))) for i in range(20)]  # branches everywhere
    got = substrings.remove_repeats(frame(spark, rows).repartition(4), width, k)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_repeats(rows, width)
    assert substrings.remove_repeats(frame(spark, []), width, k).count() == 0


def test_substring_paths_tell_words_of_one_hash_apart(monkeypatch):
    """Two words that are equal in the first hash are not in the second."""
    of = substrings.fingerprints
    monkeypatch.setattr(substrings, "fingerprints", lambda strings, *seed: of(
        [w if seed else w.replace("other", "word") for w in strings], *seed))
    text = prose(random.Random(6), 60).split()
    texts = [" ".join(text[:25] + [w] + text[25:]) for w in ("word", "other", "word")]
    batch = pa.record_batch({"doc_id": [1, 2, 3], "row_key": [1, 2, 3], "text": texts})
    found = collections.defaultdict(list)
    for part in substrings._paths(50, 15)(iter([batch])):
        for r in part.to_pylist():
            found[r["doc_id"]].append((r["anchor"], r["surroundings"]))
    assert found[1] == found[3] and not set(found[1]) & set(found[2])
    assert {a for a, _ in found[1]} == {a for a, _ in found[2]}


# ---------------------------------------------------------------- 7 packing


def test_packing_cuts_and_fills(spark):
    rng = random.Random(3)
    special = ["İstanbul ΣΑΣ don't éa, A<|endoftext|>B <|ENDOFTEXT|> x., ., ,. a b\x1cc 3,5. naïve. O'Neil's,", "ﬁn. Ω, É."]
    rows = [(i, prose(rng, rng.randint(1, 900))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, special[0]), (103, special[1]), (104, prose(rng, 20_000)), (None, "x y"), (7, rows[7][1])]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack_documents(frame(spark, rows).repartition(2), path).collect()
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    by_doc, by_sequence = collections.defaultdict(dict), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].setdefault(p["start"], []).append((ids.tolist(), p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for (i, ids), times in want.items():
        if times == 1:
            assert [x for s in sorted(by_doc[i]) for x in by_doc[i][s][0][0]] == list(ids)
            assert {n for v in by_doc[i].values() for _, n in v} == {len(ids)}
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    for parts in by_sequence.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_words_of_letters_go_to_the_model_alone():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xdf, 0x100)) if c.isalpha())
    plain = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3000)))
    odd = ["ªº", "a1", "don't", "e\u0301", "Éa", "ŉ", "日本", "a\u0307", "µ"]
    words = packing.WordIds(path)
    seen, tokenizer = [], words.tokenizer

    class Counted:
        def encode(self, text, **options):
            seen.extend(text.split(" "))
            return tokenizer.encode(text, **options)

    words.tokenizer = Counted()
    texts = [" ".join(plain), " ".join(odd + plain[:5]), "".join(f"{w.title()}. " for w in plain)]
    got = [ids.tolist() for ids in words.texts(pa.array(texts))]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert not set(plain) & set(seen)


def test_forms_of_a_word_are_remembered_as_one(monkeypatch):
    """Case and a mark at the end neither fill a task's memory of words nor have a word tokenized again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordIds(path)
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    seen, tokenizer = collections.Counter(), words.tokenizer

    class Counted:
        def encode(self, text, **options):
            seen.update(text.split(" "))
            return tokenizer.encode(text, **options)

    words.tokenizer = Counted()
    texts = ["".join(f"{i}x {i}X. {i}x, {i}X " for i in some) for some in (range(50), range(50), range(20, 70), range(10))]
    for text in texts:
        got, = words.texts(pa.array([text]))
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert [seen[f"{i}x"] for i in (0, 5, 30, 69)] == [2, 2, 1, 1] and max(len(w) for w in seen) == 3


def test_a_tokenizer_of_another_form_sees_all_words(tmp_path):
    rules = json.loads(pathlib.Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    rules["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "a"}, "content": "o"})
    (tmp_path / "other.json").write_text(json.dumps(rules))
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    got, = packing.WordIds(str(tmp_path / "other.json")).texts(pa.array(["banana bandana"]))
    assert got.tolist() == other.encode("banana bandana", add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [(64, 3, 20), (64, 100, 64), (16, 2, 1)])
def test_packing_keeps_all_limits(spark, limits):
    rng = random.Random(9)
    rows = [(i, [i + 1] * rng.randint(0, 90), rng.choice([0, 5, 40, None])) for i in range(60)] + [(99, None, 0)]
    examples = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss_from int").withColumn("start", F.lit("x"))
    pieces = packing.pack_examples(examples, *limits).collect()
    first = {i: f or 0 for i, _, f in rows}
    use = collections.defaultdict(lambda: [0, 0, 0])
    for p in pieces:
        stop = p["start"] + p["length"]
        for k, n in enumerate((p["length"], 1, max(0, stop - max(p["start"], first[p["doc_id"]])))):
            use[p["sequence_id"]][k] += n
    assert all(u <= limit for found in use.values() for u, limit in zip(found, limits, strict=True))
    assert sum(p["length"] for p in pieces) == sum(len(ids or []) for _, ids, _ in rows)


# ---------------------------------------------------------------- 8 and 9 vectors


def vectors(spark, seed=3, n=260, d=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, d))
    x = base[rng.integers(0, 40, n)] + rng.choice([0.02, 0.06, 0.6], (n, 1)) * rng.standard_normal((n, d)) * 0.6
    x[: n // 4] = x[0]
    rows = [(int(i), [float(v) for v in x[i].astype(np.float32)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [1.0, None] * (d // 2), 1), (n + 3, [float("nan")] * d, 1),
             (n + 4, [float("inf")] * d, 1), (n + 5, rows[0][1], None), (n + 6, [0.5, 0.25], 1), (n + 7, [], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return rows, df.withColumns({c: F.lit("x") for c in (*CLASHES, "vector", "keys", "table", "n")})


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_linked_vectors(spark):
    rows, df = vectors(spark)
    good = [(i, np.array(v), label) for i, v, label in rows if i is not None and label is not None and sound(v) and any(v)]
    links, parent = collections.Counter(), {i: i for i, _, _ in good}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, v, a in good:
        for j, w, b in good:
            if i < j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.update((i, j))
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r["vec_id"]: r for r in itq.linked_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in links)
    assert all(got[i]["n_links"] <= links[i] for i, _, _ in good) and found >= 0.9 * sum(links.values())
    assert sum(got[i]["component_id"] == root(i) for i, _, _ in good) >= 0.95 * len(good)
    for i in set(got) - {i for i, _, _ in good}:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert itq.linked_vectors(df.limit(0)).count() == 0


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(vafile, "PACK", 50)
    monkeypatch.setattr(vafile, "ASKED", 7)
    rows, df = vectors(spark)
    whole = {i: np.floor(64 * np.array(v, np.float64)) for i, v, _ in rows if i is not None and sound(v)}
    want = set()
    for q in whole:
        if q % 20 == 0:
            best = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best[:20], 1)}
    got = vafile.top_inner_products(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = vafile.top_inner_products(df.where("vec_id < 5"), F.col("vec_id") % 2 == 0, 20)
    assert few.count() == 3 * 4
    assert vafile.top_inner_products(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


# ---------------------------------------------------------------- 10 near-duplicates


def plain_near(rows):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = [x.translate(low) for x in words(t)]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in parent:
        for j in parent:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [hyperminhash.BLOCK, 400])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rng = random.Random(12)
    rows, base = corpus(), prose(rng, 120).split()
    for i in range(60):  # a group whose members lie on both sides of the threshold
        ws = list(base)
        for _ in range(rng.randint(0, 7)):
            ws[rng.randrange(len(ws))] = f"w{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(ws)))
    got = hyperminhash.near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert {tuple(r) for r in got} == plain_near(rows) and len(got) == len(rows)
    assert hyperminhash.near_duplicates(frame(spark, [])).count() == 0


def test_hyperminhash_estimate():
    rng = np.random.default_rng(4)
    shared, errors = rng.integers(0, 1 << 63, 2000, dtype=np.uint64), []
    for part in range(0, 2001, 250):
        other = np.concatenate((shared[:part], rng.integers(0, 1 << 63, 2000 - part, dtype=np.uint64)))
        prints, bounds = np.concatenate((shared, other)), np.array([0, 2000, 4000])
        regs = hyperminhash.registers(prints, bounds)
        found = hyperminhash.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([2000]), np.array([2000]))[0]
        errors.append(abs(found - part / (4000 - part)))
    assert max(errors) < hyperminhash.MARGIN
    assert 0 < hyperminhash.expected_collisions(np.array([2000]), np.array([2000]))[0] < 1e-3


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, t, "aa", f"s{i % 3}", len(t or "")) for i, t in corpus() if i is not None]
    rows += [(500 + i, prose(rng, 40) + (" scurvish zorblat scurvish" if i % 4 == 0 else ""), "aa", "s", 1) for i in range(200)]
    rows += [(800, "12 34 !!", None, "s", 8), (801, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1))
    spark.createDataFrame([(500 + i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    state, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, state = state, stage(spark, state, str(tmp_path))
        if name != "packing":
            assert state.columns == docs.columns
            state.write.parquet(str(tmp_path / name))
            state = spark.read.parquet(str(tmp_path / name))
            seen[name] = {r["doc_id"]: r["text"] for r in state.collect()}
            assert set(seen[name]) <= {r["doc_id"] for r in before.select("doc_id").collect()}
    everyone = {r[0]: r[1] for r in rows}
    assert set(everyone) - set(seen["language_id"]) == {60, 61, 62, 800, 801}
    toxic = {500 + i for i in range(0, 200, 4)}
    gone = set(seen["language_id"]) - set(seen["toxicity"])
    assert len(gone & toxic) >= 48 and len(gone - toxic) <= 3
    near = {i for i, _, _, kept in plain_near(list(seen["toxicity"].items())) if kept}
    assert set(seen["near_dedup"]) == near
    left = {i: (gone, n, t) for i, n, gone, t in plain_repeats(list(seen["near_dedup"].items()), 50)}
    assert seen["substring_dedup"] == {i: (t if g else seen["near_dedup"][i]) for i, (g, n, t) in left.items() if not g or g < n}
    packed = state.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()
    assert {r[0] for r in packed} == set(seen["substring_dedup"]) and all(r[1] == r[2] for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == state.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_batches_to_workers_are_bounded_in_bytes(spark):
    """Ten thousand long texts are not handed over at once."""
    prepare(spark)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "repeat('word ', 1000) text")

    def held(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    rows = docs.mapInArrow(held, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in rows) == 4000
    assert max(r["bytes"] for r in rows) < 2 * BATCH_BYTES
