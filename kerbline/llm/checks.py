"""SQL checks of the queries that SQL can express."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

SECRETS = r"""
WITH cut AS (
  SELECT doc_id, k, string_split_regex(t, p) AS gaps, regexp_extract_all(t, p) AS hits
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    (VALUES (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
            (1, 'AKIA[A-Z0-9]{16,}'), (2, '[0-9a-f]{24,}'), (3, '[0-9A-Fa-f]{20,}'), (4, '[A-Za-z0-9+/_=-]{20,}')) v(k, p)),
pieces AS (SELECT doc_id, k, unnest(range(1, len(hits) + 1)) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit FROM cut WHERE len(hits) > 0),
placed AS (
  SELECT doc_id, k, i, hit, right(gap, 64) AS before, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop
  FROM pieces),
base AS (
  SELECT doc_id, k, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE CASE k WHEN 0 THEN length(regexp_extract(hit, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(.+)$', 1)) >= 6
    WHEN 1 THEN length(hit) >= 20 WHEN 2 THEN length(hit) >= 24 ELSE false END),
candidates AS (
  SELECT doc_id, k, (stop - length(hit))::BIGINT AS start, hit FROM placed
  WHERE k >= 3 AND length(hit) >= 20
    AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND NOT regexp_matches(hit, '^[A-Za-z+/_=-]*$') AND NOT regexp_matches(hit, '^[0-9+/_=-]*$')
    AND NOT regexp_matches(hit, '(?i)0123456789|abcdefghijklmnop|example|xxxxxxxx')
    AND NOT regexp_matches(before, '(?i)sha(1|256|384|512)[-:]$') AND NOT regexp_matches(before, '(?i);base64,$')
    AND NOT regexp_matches(before, '(?i)[a-z]://\S*$')),
windows AS (SELECT doc_id, k, start, w, hit[w:w + 19] AS win FROM (SELECT *, unnest(range(1, length(hit) - 18)) AS w FROM candidates)),
letters AS (SELECT doc_id, k, start, w, ch, count(*) AS n FROM (SELECT *, unnest(string_split(win, '')) AS ch FROM windows) GROUP BY ALL),
high AS (
  SELECT doc_id, k, start, start + w - 1 AS f, start + w + 19 AS t FROM letters GROUP BY doc_id, k, start, w
  HAVING log2(20) - sum(n * log2(n)) / 20 >= CASE k WHEN 3 THEN 3.0 ELSE 3.9 END - 1e-6),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k, start ORDER BY f) AS run FROM (
  SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY doc_id, k, start ORDER BY f) <= 20 THEN 0 ELSE 1 END AS fresh FROM high)),
merged AS (SELECT doc_id, k, min(f) AS start, max(t) AS stop FROM runs GROUP BY doc_id, k, start, run),
third AS (SELECT * FROM merged m WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start <= m.start AND m.stop <= b.stop)),
fourth AS (SELECT * FROM merged m WHERE k = 4 AND NOT EXISTS (
  SELECT 1 FROM (FROM base UNION ALL FROM third) b WHERE b.doc_id = m.doc_id AND b.start <= m.start AND m.stop <= b.stop)),
named AS (
  SELECT *, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][k + 1] || ':' || start || ':' || stop AS x
  FROM (FROM base UNION ALL FROM third UNION ALL FROM fourth)),
told AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
    string_agg(x, ',' ORDER BY start, k, stop) FILTER (k < 3) AS fixed, string_agg(x, ',' ORDER BY start, k, stop) AS every
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(fixed, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)
"""

TOP_INNER_PRODUCTS = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

MERKLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, source, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS inverse_crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(inverse_crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM fields),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
level(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM ranked
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM level WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS (SELECT lang, lvl AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM level WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
root AS (SELECT lvl AS height, h AS root FROM top WHERE n = 1),
walk(lang, place, k, pos, top_pos, proof, h) AS (
  SELECT r.lang, r.pos, 0, r.pos, s.pos, '', coalesce(changed, leaf) FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
  UNION ALL
  SELECT w.lang, w.place, w.k + 1, w.pos // 2, w.top_pos, w.proof || coalesce(l.h, t.h, ''),
    CASE WHEN w.pos % 2 = 1 THEN sha256(coalesce(l.h, t.h, '') || w.h) ELSE sha256(w.h || coalesce(l.h, t.h, '')) END
  FROM (SELECT *, pos + 1 - 2 * (pos % 2) AS other FROM (
      SELECT w.lang, w.place, w.k, CASE WHEN w.k = s.height THEN w.top_pos ELSE w.pos END AS pos, w.top_pos, w.proof, w.h
      FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang)) w
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang CROSS JOIN root r
  LEFT JOIN level l ON w.k < s.height AND l.lang IS NOT DISTINCT FROM w.lang AND l.lvl = w.k AND l.pos = w.other
  LEFT JOIN top t ON w.k >= s.height AND t.lvl = w.k - s.height AND t.pos = w.other
  WHERE w.k < s.height + r.height),
done AS (SELECT w.* FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang CROSS JOIN root r WHERE w.k = s.height + r.height)
SELECT r.doc_id, r.leaf, s.subroot, root.root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = root.root AS verified
FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root JOIN done d ON d.lang IS NOT DISTINCT FROM r.lang AND d.place = r.pos
"""
