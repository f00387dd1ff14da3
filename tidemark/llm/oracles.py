"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(12) || chr(13) || chr(11)"

OP5_URL_FILTER = r"""
WITH RECURSIVE urls AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
refs AS (
  SELECT url, regexp_extract(url, '^.*?://[^/?#]*', 0, 's') AS origin, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(url, '^.*?:', 0, 's') AS scheme,
    replace(unnest(list_concat(
      list_transform(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'si'), lambda x: regexp_extract(x, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'si')),
      list_transform(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'si'), lambda x: regexp_extract(x, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'si')))), '&amp;', '&') AS ref
  FROM pages WHERE contains(url, '://')),
named AS (
  SELECT url AS a, CASE WHEN ref = '' OR starts_with(ref, '#') THEN NULL WHEN contains(ref, '://') THEN ref WHEN starts_with(ref, '//') THEN scheme || ref WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(ref, '/') THEN origin || ref WHEN starts_with(ref, '?') THEN origin || path || ref
    ELSE origin || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^.*/', 0, 's') ELSE '/' END || regexp_replace(ref, '^\./', '') END AS b FROM refs),
links AS (
  SELECT translate(regexp_extract(a, '^.*?://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(a, length(regexp_extract(a, '^.*?://[^/?#]*', 0, 's')) + 1) AS a,
    translate(regexp_extract(b, '^.*?://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(b, length(regexp_extract(b, '^.*?://[^/?#]*', 0, 's')) + 1) AS b FROM named),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
ends AS (SELECT a, b, substr(b, strpos(b, '://') + 3) AS rest FROM reach),
judged AS (
  SELECT e.a, r.verdict, row_number() OVER (PARTITION BY e.a, e.b ORDER BY length(r.host || r.path) DESC) AS k
  FROM ends e JOIN rules r ON (lower(regexp_extract(rest, '^[^/?#]*')) = r.host OR ends_with(lower(regexp_extract(rest, '^[^/?#]*')), '.' || r.host))
    AND starts_with(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), r.path)),
classes AS (SELECT a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM judged WHERE k = 1 GROUP BY a)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, c.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1 LEFT JOIN classes c ON c.a = translate(regexp_extract(p.url, '^.*?://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(p.url, length(regexp_extract(p.url, '^.*?://[^/?#]*', 0, 's')) + 1)
"""

OP7_LINE_DEDUP = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
line_rows AS (SELECT doc_id, text, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM raw),
filled AS (SELECT *, trim(line, {WHITE}) AS body FROM line_rows),
placed AS (SELECT *, CASE WHEN body <> '' THEN row_number() OVER (PARTITION BY doc_id, body <> '' ORDER BY line_no) - 1 END AS pos FROM filled),
kept_lines AS (SELECT doc_id, pos, body FROM placed WHERE pos IS NOT NULL),
windows AS (
  SELECT doc_id, pos, body AS l0, lead(body) OVER w AS l1, lead(body, 2) OVER w AS l2 FROM kept_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS k FROM windows WHERE l2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
marked AS (SELECT p.*, g.pos IS NOT NULL AS dropped FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos),
sums AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped) AS clean, count(pos) AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.clean, '') END AS text, CAST(coalesce(s.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(s.n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN sums s USING (doc_id)
"""

OP8_EXACT_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT k, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS all_n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
langs AS (SELECT l.lang, count(term) AS v, coalesce(sum(all_n), 0)::HUGEINT AS lang_n FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM groups g LEFT JOIN held USING (lang, source) GROUP BY g.lang, g.source),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 2)) // (s.group_n + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 2)) // (l.lang_n + 2 * l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over_terms AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM over_terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 10)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""

OP13_PREFIX_TRIE = r"""
WITH ids AS (SELECT conv_id, max(n) AS n FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id) GROUP BY conv_id),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ord FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id, bit by bit
heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM ids),
lent AS (SELECT h.conv_id, t.ord AS pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.ord <= h.h),
own AS (SELECT h.conv_id, t.ord + 10 AS pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.ord > h.h),
rebuilt AS (SELECT * FROM lent UNION ALL SELECT * FROM own),
paths AS (SELECT i.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path FROM ids i LEFT JOIN rebuilt USING (conv_id) GROUP BY i.conv_id),
members AS (SELECT conv_id, len(path) AS length, unnest(range(len(path) + 1)) AS depth, path FROM paths),
keyed AS (SELECT conv_id, depth, depth = length AS ends_here, path[:depth] AS node, CASE WHEN depth > 0 THEN path[:depth - 1] END AS parent FROM members),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends_here), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM keyed GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
below AS (
  SELECT n.node[:k] AS node, n.saved, CASE WHEN c.node IS NULL THEN 1 ELSE 0 END AS leaf
  FROM (SELECT node, saved, unnest(range(depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.node = n.node),
subtrees AS (SELECT node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent
"""
