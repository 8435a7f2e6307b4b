"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from cohortal.llm import quality
from cohortal.llm.text import WORD

URLS = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages),
rest AS (
  SELECT page_id, contains(u, '://') AS has, substr(u, strpos(u, '://') + 3) AS r FROM parts),
hp AS (
  SELECT page_id,
    CASE WHEN has THEN translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(r, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM rest),
rules(rhost, rpath, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
pairs AS (SELECT DISTINCT host, path FROM hp),
fit AS (
  SELECT host, path, rhost || rpath AS rule, says,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, says = 'block' DESC, rhost || rpath DESC) AS k
  FROM pairs JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT hp.page_id, hp.host, hp.path, fit.rule, coalesce(fit.says, 'allow') AS verdict
FROM hp LEFT JOIN fit ON fit.k = 1 AND hp.host = fit.host AND hp.path = fit.path"""

#: All pairs of shingle sets that share a shingle, and classes by recursion: for small tables.
JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
reps AS (SELECT sh, min(doc_id) AS rep, count(*) AS n_copies, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM reps),
i AS (SELECT a.rep AS u, b.rep AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT u, v FROM i WHERE k >= 0.8 * (nu + nv - k) - 1e-9),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT rep AS node, rep AS root FROM reps UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.root),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
d AS (SELECT u, count(*) AS n_links FROM b GROUP BY u)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, coalesce(reps.rep, s.doc_id) AS rep_id, coalesce(reps.n_copies, 1) AS n_copies, coalesce(d.n_links, 0) AS n_links
FROM s LEFT JOIN reps ON s.sh = reps.sh AND len(s.sh) > 0 LEFT JOIN c ON c.node = reps.rep LEFT JOIN d ON d.u = reps.rep"""


def quality_rules() -> str:
    """Counts by lists and windows; the line rules as one CASE."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    symbols = lambda c: f"len(regexp_extract_all({c}, '[#*$%&|<>]'))"
    nav_split = r"\s*[|»›>·•/]\s*|\s{2,}|\t"
    nav_item = f"(?i)^(?:{quality.NAVIGATION})$"
    boiler = rf"(?i)\b(?:{quality.BOILERPLATE})\b|©"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{WORD}') AS ws FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '{WORD}') AS ws FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{WORD}')),
items AS (SELECT *, len(ws) AS n, list_filter(string_split_regex(trim(line), {q(nav_split)}), lambda a: a <> '') AS items FROM lines),
ruled AS (SELECT doc_id, line, n,
    (n >= 3 AND {symbols("line")} > 0.3 * n) OR (n >= 4 AND len(regexp_extract_all(line, '[!?]{{2,}}')) > 0.3 * n)
    OR (n >= 8 AND NOT regexp_matches(line, {q(quality.SENTENCE_MARK.pattern)}))
    OR (n >= 6 AND len(list_filter(range(1, n), lambda i: ws[i] = ws[i + 1])) > 0.4 * n)
    OR (n <= 12 AND len(items) > 0 AND len(list_filter(items, lambda a: regexp_matches(trim(a, ' .:»›<>'), {q(nav_item)}))) > 0.5 * len(items))
    OR (n <= 30 AND regexp_matches(line, {q(boiler)})) AS bad
  FROM items),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines, sum(CASE WHEN bad THEN n ELSE 0 END) AS n_lost FROM ruled GROUP BY doc_id),
a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST({symbols("x")} AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost_words
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT n_lost_words > 0.5 * n_words AS kept FROM a"""

#: CRC-32 by its polynomial, byte by byte; words one apart by the strings that deletions leave.
SPELLING = r"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)),
per AS (SELECT id, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(id || ':' || w))), 2), lambda p: ('0x' || hex(encode(id || ':' || w))[p:p+1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM per, tab),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1),
words AS MATERIALIZED (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5),
gone AS MATERIALIZED (
  SELECT word, n, p, word[1:p - 1] || word[p + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM gone a JOIN gone b USING (rest, p) WHERE a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word),
best AS (
  SELECT word, count(*) AS near_n, max(m) AS m, min(other) FILTER (m = top) AS other
  FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(near_n, 0) AS near_n, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.near_n, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.root = e.word AND e.form IS NULL"""

NEGATIVES = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS "rank",
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY "rank" <= 5"""
