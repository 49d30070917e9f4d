"""SQL for DuckDB that gives the results of operators whose work relations can express.

Each takes the definition, not the method: every window, every pair of sets that share a shingle, all components.
"""

WORD = r"'[^\x20\x09-\x0D]+'"

#: op1: windows of 13 words, the least document of each, words covered by a window that starts in an earlier one.
SUBSTRING_DEDUP = rf"""WITH w AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, {WORD}), []) AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS win, unnest(range(1, len(ws) - 11)) AS i FROM w),
least AS (SELECT win, min(doc_id) AS source FROM win GROUP BY win),
hit AS (SELECT doc_id, i, source FROM win JOIN least USING (win) WHERE source < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
kept AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY word.i) FILTER (WHERE g.i IS NULL) AS kept FROM word LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id),
runs AS (SELECT doc_id, sum(CASE WHEN i - before = 1 AND source = its THEN 0 ELSE 1 END)::BIGINT AS n FROM
  (SELECT *, lag(i) OVER o AS before, lag(source) OVER o AS its FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id),
copies AS (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE first < doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
  CASE WHEN c.doc_id IS NOT NULL AND len(ws) >= 13 THEN 1 ELSE coalesce(runs.n, 0) END::BIGINT AS n_factors
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN copies c USING (doc_id)"""

#: op9: sets of shingles, links between different sets by counting shared shingles, components by reachability.
NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
c AS (SELECT g, min(doc_id) AS node, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT node, n, unnest(g) AS h FROM c),
pairs AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node, node AS root FROM c UNION SELECT reach.node, ways.b FROM reach JOIN ways ON reach.root = ways.a),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(comp.root, s.doc_id) AS component_id, coalesce(comp.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN comp USING (node)"""
