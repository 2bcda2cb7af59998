"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

#: Shingles of three words, links of 85 percent of all pairs that share one, and their closure.
OP3 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT rid, doc_id, len(sh)::BIGINT AS n_shingles, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), '|')) END AS cid, sh FROM s),
c AS (SELECT cid, any_value(sh) AS sh, any_value(n_shingles) AS n FROM n WHERE cid IS NOT NULL GROUP BY cid),
x AS (SELECT cid, n, unnest(sh) AS g FROM c),
p AS (SELECT a.cid AS a, b.cid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.cid < b.cid AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT cid AS v, cid AS u FROM c UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.u = e2.a),
o AS (SELECT cid, min(doc_id) AS least FROM n WHERE cid IS NOT NULL GROUP BY cid),
m AS (SELECT r.v AS cid, min(o.least) AS component_id FROM r JOIN o ON o.cid = r.u GROUP BY r.v)
SELECT n.doc_id, n.n_shingles, CASE WHEN n.cid IS NULL THEN n.doc_id ELSE m.component_id END AS component_id, n.doc_id IS NOT DISTINCT FROM CASE WHEN n.cid IS NULL THEN n.doc_id ELSE m.component_id END AS kept
FROM n LEFT JOIN m USING (cid)
"""

#: Every window of every document against every window of the benchmark.
OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k : k + n - 1], ' '))) AS w FROM (SELECT *, least(13, len(ws)) AS n FROM i WHERE len(ws) > 0)),
k AS (SELECT DISTINCT n, w FROM win),
wd AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k : k + n - 1], ' '))) AS w FROM d, (SELECT DISTINCT n FROM k) WHERE len(ws) >= n),
hit AS (SELECT rid, n, p, w FROM wd SEMI JOIN k USING (n, w)),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, win.item_id::VARCHAR AS id FROM hit JOIN win USING (n, w)) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

#: Every string of 400 bytes by its hash; texts as hexadecimal, in blocks, as a place in a long string takes time to find.
OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, h, unnest(range(0, greatest(len(h) // 2 - 399, 0), 2048)) AS o FROM d),
c AS (SELECT rid, o, substr(h, 2 * o + 1, 4894) AS s FROM b),
g AS (SELECT rid, o + k AS p, hash(substr(s, 2 * k + 1, 800)) AS x FROM (SELECT rid, o, s, unnest(range(0, len(s) // 2 - 399)) AS k FROM c)),
r AS (SELECT rid, p FROM g WHERE x IN (SELECT x FROM g GROUP BY x HAVING count(*) > 1)),
i AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 400 THEN 1 ELSE 0 END AS fresh FROM r)),
s AS (SELECT rid, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY rid, run),
t AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed FROM s GROUP BY rid),
e AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS f, a AS u FROM s UNION ALL SELECT rid, max(z), NULL FROM s GROUP BY rid),
q AS (SELECT rid, string_agg(substr(h, 2 * f + 1, CASE WHEN u IS NULL THEN len(h) ELSE 2 * (u - f) END), '' ORDER BY f) AS kept FROM e JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN q USING (rid)
"""

#: Hosts, paths and rules; then the tree level by level, each with sums over its nodes and their children.
OP10 = r"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(said, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
fits AS (SELECT DISTINCT host, path, said, rule FROM h JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/')))),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM fits GROUP BY ALL),
seen AS (SELECT page_id, host, path, rule, said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE
  WHEN regexp_full_match(x, '[0-9]+(\.[A-Za-z0-9]+)?') THEN '{n}' WHEN regexp_full_match(x, '[0-9a-fA-F-]{8,}') THEN '{x}' WHEN regexp_matches(x, '[0-9]') AND length(x) >= 6 THEN '{s}'
  ELSE translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS segs FROM h LEFT JOIN best USING (host, path)),
groups AS (SELECT host, segs, count(said) AS lab, count(*) FILTER (said = 'block') AS bad FROM seen GROUP BY ALL),
tree AS (SELECT host, segs, lab, bad, '' AS template, 0 AS level, false AS done FROM groups
  UNION ALL
  SELECT host, segs, lab, bad, template || CASE WHEN s = '' THEN '' WHEN children > 24 THEN '/*' WHEN children > 1 AND own_lab > 0 AND abs(own_bad - own_lab * share) / sqrt(own_lab * share * (1 - share) + 1e-9) < 2 THEN '/~' ELSE '/' || s END, level + 1, s = ''
  FROM (SELECT *, (sum(bad) OVER node + 0.5) / (sum(lab) OVER node + 1.0) AS share, count(DISTINCT s) OVER node AS children, sum(lab) OVER child AS own_lab, sum(bad) OVER child AS own_bad
    FROM (SELECT *, coalesce(segs[level + 1], '') AS s FROM tree WHERE NOT done) WINDOW node AS (PARTITION BY host, template), child AS (PARTITION BY host, template, s))),
leaf AS (SELECT host, template, sum(lab) AS lab, sum(bad) AS bad FROM tree WHERE done GROUP BY ALL),
base AS (SELECT (sum(bad) + 0.5) / (sum(lab) + 1.0) AS share FROM groups),
prior AS (SELECT host, (sum(bad) + 4.0 * any_value(share)) / (sum(lab) + 4.0) AS prior FROM leaf, base GROUP BY host),
judged AS (SELECT tree.host, segs, tree.template, (leaf.bad + 4.0 * prior) / (leaf.lab + 4.0) AS purity FROM tree JOIN leaf USING (host, template) JOIN prior USING (host) WHERE done)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM seen JOIN judged USING (host, segs)
"""

SQL = {"op3_near_duplicates": OP3, "op5_decontamination": OP5, "op8_suffix_dedup": OP8, "op10_url_filter": OP10}
