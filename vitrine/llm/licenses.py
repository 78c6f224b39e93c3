"""Licence scan by sentence rules, in DataFrame functions only.

A text is normalised (lower case, runs of anything but letters and digits are one space) with its ends of sentences
marked. A known licence sentence is found where its words, all of them and no others, lie between two ends; it may
have ends within, since full stops, semicolons, list numbers and colons stand within licence sentences too. The
identifiers found, in order, form a sequence; ordered rules, longer ones first, look for their own sequence in it,
report a licence and use those identifiers up. What no rule uses is reported too. Line ends are such ends, and as
they may lie within as well, wrapped licence texts are found beside others. Texts without any ANCHOR, which every
known sentence has (its two words may be wrapped, too), are not read at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = "licen|copyright|permission|redistribut|warrant|public domain"
#: ANCHOR in a text as it is, where anything but letters and digits can lie between two words.
WORTH = ANCHOR.replace(" ", "[^a-z0-9]+")

# Sentences of well-known licences as they read after normalising, and what they are called here.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_ref": "released under the mit license",
    "mit_ref_2": "licensed under the mit license",
    "mit_spdx": "spdx license identifier mit",
    "apache2_ref": "licensed under the apache license version 2 0",
    "apache2_header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_spdx": "spdx license identifier apache 2 0",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl2_ref": "this work is licensed under the gnu general public license version 2",
    "gpl3_later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gnu_no_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl3_spdx": "spdx license identifier gpl 3 0 only",
    "gpl2_spdx": "spdx license identifier gpl 2 0 only",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2_ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc_by_ref": "licensed under cc by 4 0",
    "cc_by_sa_ref": "licensed under cc by sa 4 0",
    "cc_by_nc_ref": "licensed under cc by nc 4 0",
    "cc_by_nc_sa_ref": "licensed under cc by nc sa 4 0",
    "cc0_ref": "this work is dedicated to the public domain",
    "reserved": "copyright all rights reserved",
}
# Rules in the order in which they apply.
RULES = (
    ("Apache-2.0", ("apache2_header", "apache2_copy", "apache2_as_is")),
    ("Apache-2.0", ("apache2_header", "apache2_as_is")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_as_is")),
    ("GPL-3.0-or-later", ("gpl3_later", "gnu_no_warranty")),
    ("GPL-2.0-or-later", ("gpl2_later", "gnu_no_warranty")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_ref_2",)),
    ("MIT", ("mit_spdx",)),
    ("Apache-2.0", ("apache2_header",)),
    ("Apache-2.0", ("apache2_ref",)),
    ("Apache-2.0", ("apache2_spdx",)),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("GPL-3.0-only", ("gpl3_spdx",)),
    ("GPL-2.0-only", ("gpl2_ref",)),
    ("GPL-2.0-only", ("gpl2_spdx",)),
    ("MPL-2.0", ("mpl2_ref",)),
    ("CC-BY-4.0", ("cc_by_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_ref",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
)
# What does not end a sentence though a full stop and white space follow it, or ends one, is left to the patterns.
END = r"[.;:!?][ \t\r\n]+|(?<=/license-2\.0)[ \t]+|[\r\n]+"
#: Known sentences between ends, longer ones first, after a list number or letter if there is one.
KNOWN = r"(?<![^|])(?:[0-9]{1,2} |[a-z] )?(%s)(?![^|])" % "|".join(
    s.replace(" ", "[ |]") for s in sorted(SENTENCES.values(), key=len, reverse=True))


def marked(text: Column) -> Column:
    """Normalised words with | for every end of a sentence or line."""
    ended = F.regexp_replace(F.translate(F.lower(text), "|", " "), END, "|")
    return F.trim(F.regexp_replace(F.regexp_replace(ended, "[^a-z0-9|]+", " "), r" ?\|[ |]*", "|"))


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a marked text, in order."""
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (s, name)))
    found = F.regexp_extract_all(text, F.lit(KNOWN), F.lit(1))
    return F.transform(found, lambda s: F.element_at(known, F.translate(s, "|", " ")))


def _apply(sequence: Column) -> tuple[Column, Column]:
    """Licences that the rules report, in the order of the rules, and the identifiers left over."""
    hits = []
    for name, rule in RULES:
        own = "".join(f"<{x}>" for x in rule)
        hits.append(F.when(F.contains(sequence, F.lit(own)), F.lit(name)))
        sequence = F.replace(sequence, F.lit(own), F.lit("."))
    return F.array_distinct(F.array_compact(F.array(*hits))), sequence


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses, unmatched and kept-apart flags for every row of ``docs`` (doc_id, text).

    ``sentence_ids`` are the identifiers in order, ``licenses`` the licences sorted, ``unmatched`` the identifiers
    no rule used, each joined by a comma; ``n_sentences`` counts the identifiers. A null or empty text has none of
    them (empty strings and 0). Rows are scanned one by one, whole texts, so ties, repeated rows and an empty table
    need no rule; other columns are ignored.
    """
    rows = docs.selectExpr("doc_id", "coalesce(cast(text as string), '') as text")
    worth = F.lower("text").rlike(WORTH)
    ids = rows.select("doc_id", F.when(worth, identifiers(marked(F.col("text")))).otherwise(
        F.array().cast("array<string>")).alias("ids"))
    wrapped = ids.withColumn("sequence", F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">")))))
    licences, left = _apply(F.col("sequence"))
    done = wrapped.select("doc_id", "ids", F.sort_array(licences).alias("found"), left.alias("rest"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("found", ",").alias("licenses"),
        F.array_join(F.expr(r"transform(regexp_extract_all(rest, '<([a-z0-9_]+)>', 1), x -> x)"), ",").alias("unmatched"))


def duckdb_sql() -> str:
    """The scan in DuckDB SQL over ``documents``, with known sentences only where they have no end within."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = f"MAP([{', '.join(map(quoted, SENTENCES.values()))}], [{', '.join(map(quoted, SENTENCES))}])"

    def cut(text: str) -> str:
        parts = f"string_split(regexp_replace({text}, '([.;!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))"
        clean = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
        return (f"CASE WHEN regexp_matches(lower(text), '{ANCHOR}') THEN list_filter(list_transform({parts}, "
                f"lambda s: known[{clean}]), lambda x: x IS NOT NULL) ELSE [] END")

    steps, hits, last = [], [], "s0"
    joined = "regexp_replace(text, '[\\r\\n]+', ' ', 'g')"
    for i, (name, rule) in enumerate(RULES):
        own = quoted("".join(f"<{x}>" for x in rule))
        hits.append(f"CASE WHEN contains(s{i}, {own}) THEN {quoted(name)} END")
        steps.append(f"r{i + 1} AS (SELECT *, replace(s{i}, {own}, '.') AS s{i + 1} FROM r{i})")
        last = f"s{i + 1}"
    return f"""
WITH k AS (SELECT {known} AS known),
t AS (SELECT doc_id, coalesce(text, '') AS text, known FROM documents, k),
c AS (SELECT doc_id, {cut("text")} AS lines, {cut(joined)} AS joined FROM t),
i AS (SELECT doc_id, CASE WHEN len(joined) > len(lines) THEN joined ELSE lines END AS ids FROM c),
r0 AS (SELECT *, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS s0 FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL))), ','), '') AS licenses,
  coalesce(array_to_string(regexp_extract_all({last}, '<([a-z0-9_]+)>', 1), ','), '') AS unmatched
FROM r{len(RULES)}
"""
