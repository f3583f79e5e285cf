"""DuckDB twins of the corpus queries that SQL can say over whole tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, k, line, regexp_extract_all(line, '[^ \t\n\x0b\f\r]+') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
f AS (SELECT doc_id, k, array_to_string(w, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS s, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS up_to, len(w) AS n FROM l WHERE len(w) > 0),
e AS (SELECT a.doc_id, a.s, min(b.s) AS e FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.s BETWEEN a.s AND a.s + 2 AND (b.s = a.s + 2 OR b.up_to - a.up_to + a.n >= 50) GROUP BY ALL
  UNION SELECT b.doc_id, max(a.s) AS s, b.s AS e FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.s BETWEEN b.s - 2 AND b.s AND (a.s = b.s - 2 OR b.up_to - a.up_to + a.n >= 50) GROUP BY b.doc_id, b.s),
w AS (SELECT e.doc_id, e.s, e.e, string_agg(f.line, chr(10) ORDER BY f.s) AS body FROM e JOIN f ON e.doc_id = f.doc_id AND f.s BETWEEN e.s AND e.e GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
g AS (SELECT DISTINCT f.doc_id, f.k FROM r JOIN f ON r.doc_id = f.doc_id AND f.s BETWEEN r.s AND r.e),
t AS (SELECT l.doc_id, count(*) FILTER (len(l.w) > 0) AS n_lines, count(g.k) AS n_deleted, string_agg(l.line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL) AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT d.doc_id, t.n_lines, t.n_deleted, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text FROM documents d JOIN t ON d.doc_id = t.doc_id
"""

URL_FILTER = f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT q.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict FROM q JOIN rules r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p) GROUP BY q.page_id)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, CASE WHEN q.host != '' AND regexp_matches(q.host || q.path,
  '(^|[^A-Za-z0-9])(spam[^A-Za-z0-9]farm|cheap[^A-Za-z0-9]pills|free[^A-Za-z0-9]casino|adserver|doubleclick|xxx|wp[^A-Za-z0-9]login)([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m ON q.page_id = m.page_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT item, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
o AS (SELECT dw.doc_id, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM o) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(c.n_items, 0) AS n_items, sha256(coalesce(c.items, '')) AS items_sha256, coalesce(c.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
