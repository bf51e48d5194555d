"""DuckDB SQL with the same results as queries of this subpackage."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(2, len(w) - 8))) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) r(i)),
o AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP3 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i - 1, 100)) AS s FROM d, unnest(range(1, greatest(1, length(x) // 2 - 48))) r(i)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b FROM k GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
c AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM w, unnest(range(1, greatest(2, len(w)))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s, count(*) AS often FROM s GROUP BY s),
k AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY often, s) AS rank FROM s JOIN n USING (doc_id) JOIN f USING (s)),
p AS (SELECT doc_id, s, n FROM k WHERE rank <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
l AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u AS doc_id, min(v) AS m FROM r GROUP BY u)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS s FROM d, unnest(range(1, greatest(1, len(w) - 11))) r(i)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (s) WHERE first < doc_id),
c AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string([x FOR x, i IN w IF gone IS NULL OR NOT list_contains(gone, i)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

OP12 = r"""
WITH RECURSIVE b AS (
  SELECT doc_id, source, text, rank() OVER (ORDER BY source NULLS FIRST) AS r,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
  FROM documents),
d AS (SELECT *, dense_rank() OVER (ORDER BY r) AS s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS said FROM b),
k AS (SELECT doc_id, s, leaf, sha256(head || coalesce(strlen(said) || ':' || said, '-')) AS tampered,
        row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
t(s, level, i, h, n) AS (SELECT s, 0, i, leaf, n FROM k
  UNION ALL SELECT s, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY s, level, i // 3, n),
u AS (SELECT s, level AS top, h AS subroot FROM t WHERE n = 1),
g(level, i, h, n) AS (SELECT 0, s - 1, subroot, count(*) OVER () FROM u
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM g WHERE n > 1 GROUP BY level, i // 3, n),
tr AS (SELECT s, level, i // 3 AS p, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY s, level, i // 3),
gr AS (SELECT level, i // 3 AS p, list(h ORDER BY i) AS hs FROM g WHERE n > 1 GROUP BY level, i // 3),
f(doc_id, s, leaf, level, i, v, sibs) AS (SELECT doc_id, s, leaf, 0, i, tampered, '' FROM k
  UNION ALL SELECT doc_id, f.s, leaf, f.level + 1, i // 3, sha256(array_to_string(list_concat(hs[:i % 3], [v], hs[i % 3 + 2:]), '')),
    sibs || array_to_string(list_concat(hs[:i % 3], hs[i % 3 + 2:]), '') FROM f JOIN tr ON tr.s = f.s AND tr.level = f.level AND tr.p = f.i // 3),
e(doc_id, leaf, subroot, level, i, v, sibs) AS (SELECT doc_id, leaf, subroot, 0, f.s - 1, v, sibs FROM f JOIN u ON u.s = f.s AND u.top = f.level
  UNION ALL SELECT doc_id, leaf, subroot, e.level + 1, i // 3, sha256(array_to_string(list_concat(hs[:i % 3], [v], hs[i % 3 + 2:]), '')),
    sibs || array_to_string(list_concat(hs[:i % 3], hs[i % 3 + 2:]), '') FROM e JOIN gr ON gr.level = e.level AND gr.p = e.i // 3)
SELECT doc_id, leaf, subroot, g.h AS root, sha256(sibs) AS proof_sha256, v AS folded_root, v = g.h AS verified
FROM e JOIN g ON g.n = 1 AND g.level = e.level"""
