"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(ws[k:k + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) t(k)),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
starts AS (SELECT doc_id, k FROM win JOIN firsts USING (h) WHERE m < doc_id),
words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
marked AS (SELECT words.doc_id, i, word, coalesce(max(k) OVER (PARTITION BY words.doc_id ORDER BY i) >= i - 49, false) AS gone FROM words LEFT JOIN starts ON words.doc_id = starts.doc_id AND i = k),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS s FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[k:k + 4], ' ')) AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.m, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)"""

OP8 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, k, md5(substr(h, 2 * k - 1, 800)) AS g FROM d, unnest(range(1, n - 398)) t(k)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT doc_id, k FROM win WHERE g IN (SELECT g FROM twice)),
bytes AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS x FROM d, unnest(range(1, n + 1)) t(i)),
marked AS (SELECT bytes.doc_id, i, x, coalesce(max(k) OVER (PARTITION BY bytes.doc_id ORDER BY i) >= i - 399, false) AS gone FROM bytes LEFT JOIN starts ON bytes.doc_id = starts.doc_id AND i = k),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE first) AS s, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS y FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(y, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

QUALITY_BASE = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
tri AS (SELECT doc_id, k, array_to_string(ws[k:k + 2], ' ') AS g FROM w, unnest(range(1, len(ws) - 1)) t(k)),
rep AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM rep, unnest(range(3)) r(o) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM w, unnest(string_split(text, chr(10))) l(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(dup.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""

URL_RULES = r"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p) AS (VALUES ('net', '/'), ('example.net', '/en/'), ('example.com', '/de/'), ('org', '/fr/')),
f AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule FROM b LEFT JOIN f USING (page_id)"""
