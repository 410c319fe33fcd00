"""SQL of the operators that SQL can express."""

from __future__ import annotations

from . import licenses
from .common import words

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, item_id, i, n FROM doc_windows JOIN item_windows USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""


def licenses_sql() -> str:
    phrases = {tuple(w.decode() for w in words(p)): label for p, label in licenses.BASE.items()}
    at = " OR ".join(f"w[i : i + {len(p) - 1}] = [{', '.join(repr(x) for x in p)}]" for p in phrases)
    base = [f"CASE WHEN contains(s, '{''.join(f' {x} ' for x in p)}') THEN '{label}' END" for p, label in phrases.items()]
    begin = {label: "".join(f" {w.decode()} " for w in words(t.partition("<<")[0])) for label, t in licenses.TEMPLATES.items()}
    more = [f"CASE WHEN contains(s, '{begin[label]}') THEN CASE WHEN regexp_matches(s, '{licenses.template_regex(t)}') THEN '{label}' END END" for label, t in licenses.TEMPLATES.items()]
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
e AS (SELECT *, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS s FROM d),
places AS (SELECT r, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {at}),
p AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b FROM places GROUP BY r),
l AS (SELECT *, list_filter([{', '.join(base)}], lambda x: x IS NOT NULL) AS base, list_filter([{', '.join(more)}], lambda x: x IS NOT NULL) AS more FROM e)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels,
  CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l LEFT JOIN p USING (r)"""
