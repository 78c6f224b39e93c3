"""Building blocks of the SQL twins."""

from __future__ import annotations

import re

from registry.frames import PHRASES
from vitrine.functions import keywords as K


def r(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def fixed(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {r(x, digits)})"


def percent(x: str) -> str:
    return f"(CAST(CAST({r(f'({x}) * 100', 0)} AS BIGINT) AS VARCHAR) || '%')"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def facet(x: str) -> str:
    return (f"nullif(trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-'), '')")


CATALOG = f"""
catalog AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category,
  p_retailprice AS price, split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS material,
  (['Summer','Winter','Spring','Fall'])[p_size % 4 + 1] AS season,
  CASE p_size % 3 WHEN 1 THEN 'Casual' WHEN 2 THEN 'Formal' END AS style,
  [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)] AS tags,
  p_size / 50.0::DOUBLE AS quality_score, {facet('p_brand')} AS brand_key,
  {facet('p_type')} AS category_key, p_size FROM part)"""

SUBMITTED = f"""
submitted AS (SELECT p_partkey AS product_id, p_name AS name,
  CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand,
  CASE WHEN p_size % 7 <> 0 THEN p_type END AS category,
  concat_ws(' ', ({sql_list(PHRASES)})[p_size % {len(PHRASES)} + 1], text) AS description,
  p_retailprice AS price FROM part LEFT JOIN documents ON doc_id = p_partkey)"""


def vectors(name: str, first: int, last: int) -> str:
    part = f"embedding[{first}:{last}]"
    return f"""
{name} AS (SELECT vec_id AS product_id, list_transform({part}, lambda x: x::DOUBLE) AS v,
  sqrt(list_inner_product(list_transform({part}, lambda x: x::DOUBLE),
                          list_transform({part}, lambda x: x::DOUBLE))) AS norm
  FROM embeddings JOIN part ON p_partkey = vec_id)"""


def neighbors(name: str, source: str, k: int) -> str:
    """All products against all, k nearest each."""
    return f"""
{name}_all AS (SELECT q.product_id AS query_id, p.product_id,
  list_inner_product(q.v, p.v) / (q.norm * p.norm) AS score FROM {source} q CROSS JOIN {source} p),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, product_id) AS rk FROM {name}_all) WHERE rk <= {k})"""


def similar(depth: int, name: str = "sim") -> str:
    """Fused neighbors of every product without itself."""
    k = depth + 1
    return f"""{CATALOG}, {vectors('vi', 1, 32)}, {vectors('vt', 33, 64)},
{neighbors('ni', 'vi', k)}, {neighbors('nt', 'vt', k)},
fused AS (SELECT coalesce(i.query_id, t.query_id) AS query_id, coalesce(i.product_id, t.product_id) AS product_id,
  coalesce(i.score, 0) AS image_score, coalesce(t.score, 0) AS text_score,
  0.7 * coalesce(i.score, 0) + 0.3 * coalesce(t.score, 0) AS score,
  concat_ws(',', CASE WHEN i.score IS NOT NULL THEN 'image' END,
            CASE WHEN t.score IS NOT NULL THEN 'text' END) AS modalities
  FROM ni i FULL JOIN nt t ON i.query_id = t.query_id AND i.product_id = t.product_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, product_id) AS rk FROM fused WHERE query_id <> product_id)
  WHERE rk <= {depth})"""


def related(depth: int, name: str = "sim") -> str:
    """Text-only neighbors of every product without itself."""
    return f"""{CATALOG}, {vectors('vt', 33, 64)}, {neighbors('nt', 'vt', depth + 1)},
{name} AS (SELECT * FROM (SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, product_id) AS rk FROM nt WHERE query_id <> product_id) WHERE rk <= {depth})"""


def tokens(x: str) -> str:
    return (f"array_to_string(list_sort(string_split_regex(nullif(lower(trim({x})), ''), '\\s+')), ' ')")


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two string expressions by the usual row recurrence."""
    return f"""list_reduce(
  list_prepend(list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT),
               list_transform(range(1, length({a}) + 1), lambda i: [i])),
  lambda prev, x: list_reduce(
    list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])),
    lambda acc, y: list_append(acc, CASE WHEN {b}[y[1]] = {a}[x[1]] THEN prev[y[1]] + 1
                       ELSE greatest(prev[y[1] + 1], acc[len(acc)]) END)))[-1]"""


def fuzzy_table(name: str, values: str) -> str:
    """(a, b, sim) for all pairs of the distinct token strings in ``values`` (column t)."""
    return f"""
{name}_v AS (SELECT DISTINCT t FROM ({values}) WHERE t IS NOT NULL),
{name} AS (SELECT l.t AS a, m.t AS b, CASE WHEN l.t = m.t THEN 1.0::DOUBLE ELSE
  2.0::DOUBLE * ({lcs('l.t', 'm.t')}) / (length(l.t) + length(m.t)) END AS sim
  FROM {name}_v l CROSS JOIN {name}_v m)"""


EDGE = r"[^\p{L}\p{N}\p{M}_]"


def first_keyword(text: str, dictionary: dict[str, str]) -> str:
    """Value of the leftmost keyword, in dictionary order at the same start."""
    alternatives = "|".join(re.escape(k).replace("\\ ", " ").replace("\\-", "-").replace("\\&", "&")
                            for k in dictionary)
    pattern = quoted(f"(?:^|{EDGE})({alternatives})(?:{EDGE}|$)")
    keys, values = sql_list(dictionary), sql_list(dictionary.values())
    return (f"({values})[list_position({keys}, regexp_extract({text}, {pattern}, 1))]")


def has_keyword(text: str, words: list[str]) -> str:
    alternatives = "|".join(re.escape(k).replace("\\ ", " ").replace("\\-", "-").replace("\\&", "&")
                            for k in words)
    return f"regexp_matches({text}, {quoted(f'(?:^|{EDGE})({alternatives})(?:{EDGE}|$)')})"


def text_attributes() -> str:
    """attrs(product_id, ord, attribute, value, confidence) of submitted products."""
    rows = []
    for i, (attribute, dictionary, confidence) in enumerate(K.ATTRIBUTE_RULES):
        found = first_keyword("txt", dictionary)
        if attribute in ("brand", "category"):
            rows.append(f"SELECT product_id, {i} AS ord, '{attribute}' AS attribute, coalesce({attribute}, {found}) "
                        f"AS value, CASE WHEN {attribute} IS NOT NULL THEN 1.0::DOUBLE ELSE {confidence}::DOUBLE END "
                        "AS confidence FROM texts")
        else:
            rows.append(f"SELECT product_id, {i}, '{attribute}', {found}, {confidence}::DOUBLE FROM texts")
    union = "\nUNION ALL ".join(rows)
    return f"""{SUBMITTED},
texts AS MATERIALIZED (SELECT *, lower(concat_ws(' ', name, category, description)) AS txt FROM submitted),
attrs AS MATERIALIZED (SELECT * FROM ({union}) WHERE value IS NOT NULL)"""


def text_tags() -> str:
    """tags(product_id, tag, confidence, ord): first of equal tags, in generation order."""
    parts = ["SELECT product_id, ord, lower(trim(value)) AS tag, confidence FROM attrs"]
    at = 100
    for attribute, dictionary, confidence in K.ATTRIBUTE_RULES:
        if attribute not in ("color", "material", "style"):
            continue
        for value in dict.fromkeys(dictionary.values()):
            words = [k for k, v in dictionary.items() if v == value]
            parts.append(f"SELECT product_id, {at}, {quoted(value.lower())}, {confidence}::DOUBLE FROM texts "
                         f"WHERE {has_keyword('txt', words)}")
            at += 1
    for word in sorted(K.DESCRIPTORS):
        parts.append(f"SELECT product_id, {at}, {quoted(word)}, 0.6::DOUBLE FROM texts WHERE {has_keyword('txt', [word])}")
        at += 1
    union = "\nUNION ALL ".join(parts)
    return f"""{text_attributes()},
tags AS (SELECT * FROM ({union}) QUALIFY row_number() OVER (PARTITION BY product_id, tag ORDER BY ord) = 1)"""
