"""DuckDB SQL for the operators that SQL can express; the tests hold the others against brute force."""

from __future__ import annotations

from pulseframe.llm.licences import LOWER, NOT_WORD, PHRASES, TEMPLATES, UPPER

THRESHOLD = 0.92


def licences_sql() -> str:
    """Phrase places by position, and every line against every template."""
    places = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
        places.append(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w) WHERE {test}")
    templates = ", ".join(f"('{label}', [{', '.join(repr(x) for x in sorted(set(text.split())))}])" for label, text in TEMPLATES)
    words = "list_filter(string_split_regex({}, '" + NOT_WORD + "'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, low, {words.format('low')} AS ws FROM d),
p AS ({' UNION ALL '.join(places)}),
b AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(min(i) AS BIGINT) AS a, CAST(max(i) AS BIGINT) AS z,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
l AS (SELECT doc_id, {words.format('line')} AS ws FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM d)),
t(label, own) AS (VALUES {templates}),
m AS (SELECT doc_id, label, len(list_intersect(own, ws)) / len(own) AS c FROM l, t WHERE len(list_intersect(own, ws)) >= ceil({THRESHOLD} * len(own) - 1e-9)),
a AS (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m),
x AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM a GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.z AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(x.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN s USING (doc_id)"""


#: Every string of 100 bytes by itself, in hex; runs of repeats as islands; what is left put together again.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
k AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n, max(z) AS z, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
