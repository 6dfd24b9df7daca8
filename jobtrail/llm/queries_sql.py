"""DuckDB SQL that gives the rows of the queries which SQL can express."""

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

SQL = {
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS s FROM d WHERE length(h) >= 100)),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) < doc_id AS hit FROM w),
e AS (SELECT doc_id, s AS pos, 1 AS step FROM m WHERE hit UNION ALL SELECT doc_id, s + 50, -1 FROM m WHERE hit),
t AS (SELECT doc_id, pos, sum(step) AS step FROM e GROUP BY ALL),
c AS (SELECT doc_id, pos, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS open, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS until FROM t),
g AS (SELECT doc_id, pos, until, coalesce(lag(open) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS was, open FROM c),
z AS (SELECT doc_id, CAST(sum(until - pos) FILTER (open > 0) AS BIGINT) AS n_removed, count(*) FILTER (open > 0 AND was = 0) AS n_spans FROM g GROUP BY doc_id),
stay AS (SELECT doc_id, pos, until FROM c WHERE open = 0 AND until IS NOT NULL
  UNION ALL SELECT doc_id, 0, min(pos) FROM c GROUP BY doc_id
  UNION ALL SELECT doc_id, max(pos), NULL FROM c GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * pos + 1, 2 * (coalesce(until, length(h) // 2) - pos)), '' ORDER BY pos) AS kept FROM stay JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op3_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op4_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
e AS (SELECT *, length(regexp_replace(line, '{GAP}', '', 'g')) AS solid FROM l),
d AS (SELECT line, min((doc_id, no)) AS first, length(any_value(line)) AS n, any_value(solid) AS solid FROM e WHERE solid > 0 GROUP BY line),
c AS (SELECT * FROM d WHERE solid >= 20),
k AS (SELECT c.*, m, 0 AS side, left(line, m // 2) AS part FROM c, LATERAL (SELECT unnest([n - 1, n]) AS m)
  UNION ALL SELECT c.*, m, 1, right(line, m - m // 2) FROM c, LATERAL (SELECT unnest([n - 1, n]) AS m)),
near AS (SELECT DISTINCT a.line FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND b.first < a.first
  WHERE levenshtein(a.line, b.line) <= 1),
x AS (SELECT l.doc_id, l.no, l.line, near.line IS NOT NULL OR coalesce((l.doc_id, l.no) > d.first, false) AS gone
  FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)), '') AS kept
  FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
""",
    "op6_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
x AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 8) AS o(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM f),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS f FROM a GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS docs, sum(f) AS bad, sum(n * n) AS squares, sum(f * f / n) AS spread FROM h),
q AS (SELECT k, bad / docs AS mean, (bad / docs) * (1 - bad / docs) AS noise, docs, squares, spread FROM s),
z AS (SELECT mean, noise * (docs - squares / docs - (k - 1)) AS scale, spread - mean * mean * docs - noise * (k - 1) AS over FROM q),
prior AS (SELECT mean, 1 / least(greatest(CASE WHEN scale > 0 THEN over / scale ELSE 0 END, 1e-6), 1 / 11) - 1 AS strength FROM z),
v AS (SELECT source, (f + mean * strength) / (n + strength) > greatest(0.5, (1 + mean) / 2) AS host_rejected FROM h, prior)
SELECT a.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM a JOIN v ON a.source IS NOT DISTINCT FROM v.source
""",
    "op12_prefix_trie": rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS said
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT c, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes FROM t),
f AS (SELECT c, xor(list_reduce(list_prepend(4294967295, codes),
  lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h FROM i),
b AS (SELECT f.c, t.p, role, said FROM f JOIN t ON t.c = f.c - f.c % 20 AND t.p <= h UNION ALL SELECT c, p, role, said FROM f JOIN t USING (c) WHERE p > h),
s AS (SELECT f.c, coalesce(list(md5(role) || md5(said) ORDER BY p) FILTER (p IS NOT NULL), []) AS e, coalesce(list(said ORDER BY p) FILTER (p IS NOT NULL), []) AS said
  FROM f LEFT JOIN b USING (c) GROUP BY f.c),
u AS (SELECT c, e, said, unnest(range(len(e) + 1)) AS d FROM s),
m AS (SELECT c, d, md5(array_to_string(e[1:d], '')) AS k, md5(array_to_string(e[1:d - 1], '')) AS up, len(e) = d AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(said[d], '{WORD}')) END AS w FROM u),
n AS (SELECT d, k, any_value(up) AS up, any_value(w) AS w, min(c) AS c, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ends FROM m GROUP BY d, k),
g AS (SELECT x.*, (SELECT count(*) FROM n y WHERE y.d = x.d + 1 AND y.up = x.k) AS kids FROM n x),
a AS (SELECT m.d, m.k, count(*) FILTER (kids = 0) AS leaves, CAST(sum((g.n - 1) * g.w) AS BIGINT) AS saved FROM g JOIN m ON m.c = g.c AND m.d <= g.d GROUP BY m.d, m.k)
SELECT g.c AS conv_id, g.d AS depth, o.c AS parent_conv_id, g.n AS n_convs, g.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN a USING (d, k) LEFT JOIN n o ON o.d = g.d - 1 AND o.k = g.up
""",
}
