"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from . import quality_rules

_WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
g AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(g.c, w.doc_id) AS component_id, coalesce(g.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN g ON g.d = w.doc_id
"""

URL_FILTER = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rh || rp) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""


def quality_rules_sql() -> str:
    """The same statistics, sketches and thresholds as in quality_rules, from its parameters."""
    q = quality_rules
    value = {m: f"({f} * {a} // greatest({b}, 1))" for m, (a, b, f, _, _) in q.MEASURES.items()}
    sketched = value | {s: s for s in q.SIZES}
    cells = "\n  UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS v FROM base WHERE NOT base_failed" for m, v in sketched.items())
    level = lambda by: f"SELECT {by}measure, b, sum(c) AS c FROM cells GROUP BY {by}measure, b"
    firsts = ", ".join(f"min(CASE WHEN 4 * upto >= {k} * n THEN b END) AS q{k}" for k in q.QUARTERS)
    quant = lambda src, by: f"SELECT {by}measure, max(n) AS n, {firsts} FROM (SELECT *, sum(c) OVER (PARTITION BY {by}measure ORDER BY b) AS upto, sum(c) OVER (PARTITION BY {by}measure) AS n FROM {src}) GROUP BY {by}measure"
    pick = lambda c: f"CASE WHEN o.n >= {q.LEAST_GROUP} THEN o.{c} WHEN l.n >= {q.LEAST_GROUP} THEN l.{c} ELSE g.{c} END AS {c}"
    at = lambda m, k: f"max(CASE WHEN measure = '{m}' THEN q{k} END)"
    fences = ",\n    ".join(f"{at(m, 3)} + {q.REACH} * ({at(m, 3)} - {at(m, 2)}) + {x[2] * x[3]} // greatest({at(x[1], 1)}, 1) AS hi_{m}" + (f", {at(m, 1)} - {q.REACH} * ({at(m, 2)} - {at(m, 1)}) AS lo_{m}" if x[4] else "") for m, x in q.MEASURES.items())
    tests = " AND ".join(f"coalesce({value[m]} <= t.hi_{m}, true)" + (f" AND coalesce({value[m]} >= t.lo_{m}, true)" if x[4] else "") for m, x in q.MEASURES.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, lang, source, text, regexp_extract_all(text, {_WORD}) AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM d),
t3 AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM t3) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base0 AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
base AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM base0),
vals AS ({cells}),
cells AS (
  SELECT lang, source, measure, (v >> greatest(length(bin(v)) - {q.BITS}, 0)) << greatest(length(bin(v)) - {q.BITS}, 0) AS b, count(*) AS c
  FROM vals GROUP BY ALL),
cl AS ({level("lang, ")}), ca AS ({level("")}),
o AS ({quant("cells", "lang, source, ")}), l AS ({quant("cl", "lang, ")}), g AS ({quant("ca", "")}),
picked AS (
  SELECT o.lang, o.source, o.measure, {", ".join(pick(f"q{k}") for k in q.QUARTERS)}
  FROM o LEFT JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure LEFT JOIN g ON o.measure = g.measure),
t AS (
  SELECT lang, source,
    {fences}
  FROM picked GROUP BY lang, source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept
FROM base b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source
"""
