"""SQL for DuckDB that gives the same rows as the queries, where SQL can express them."""

SQL = {
    "p1_found": r"""
WITH h AS (SELECT result_id, max(chunk_content) AS t FROM search_results WHERE result_id IS NOT NULL AND chunk_content IS NOT NULL GROUP BY result_id),
w AS (SELECT result_id, regexp_extract_all(lower(t), '[a-z0-9_]+') AS w FROM h),
s AS (SELECT DISTINCT result_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT result_id, count(*) AS n FROM s GROUP BY result_id),
c AS (SELECT a.result_id AS a, b.result_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.result_id < b.result_id GROUP BY 1, 2)
SELECT c.a AS result_id_a, c.b AS result_id_b FROM c JOIN n x ON x.result_id = c.a JOIN n y ON y.result_id = c.b WHERE c.c >= 0.5 * (x.n + y.n - c.c)""",
    "p5_found": r"""
WITH c AS (SELECT chunk_id, max(content) AS content FROM file_chunks WHERE strlen(content) > 4096 GROUP BY chunk_id)
SELECT chunk_id, CAST(len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) > 4096)) AS INTEGER) AS long_lines FROM c""",
    "p6_found": r"""
WITH RECURSIVE v AS (
  SELECT chunk_id, CAST(any_value(embedding) AS DOUBLE[]) AS e FROM file_chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
link AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM v a JOIN v b ON a.chunk_id <> b.chunk_id AND list_cosine_similarity(a.e, b.e) >= 0.6),
reach(a, b) AS (SELECT chunk_id, chunk_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
k AS (SELECT a AS chunk_id, min(b) AS cluster_key, count(*) AS n FROM reach GROUP BY a)
SELECT chunk_id, cluster_key FROM k WHERE n >= 5""",
    "p7_found": r"""
WITH v AS (
  SELECT chunk_id, CAST(any_value(embedding) AS DOUBLE[]) AS e FROM file_chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
t AS (SELECT a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s) WHERE r <= 3)
SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.c >= 0.975""",
    "p8_found": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: list_aggregate(w[k:k + 12], 'string_agg', ' '))) AS g FROM d WHERE len(w) >= 13),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: list_aggregate(w[k:k + 12], 'string_agg', ' '))) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    # sizes here are bytes, the tokens of the plainest tokenizer; which one is used doesn't matter to the result
    "p9_found": r"""
WITH d AS (SELECT doc_id, max(source) AS source, max(strlen(text)) AS n FROM documents GROUP BY doc_id),
s AS (SELECT source, sum(n) AS size FROM d GROUP BY source), t AS (SELECT sum(n) AS total FROM d)
SELECT m.source FROM mix_targets m LEFT JOIN s USING (source) CROSS JOIN t WHERE coalesce(s.size, 0) * m.max_repeats < m.weight * t.total""",
    # what the rules demand of every source
    "p9_kept_rules": "SELECT DISTINCT source, true AS repeats_kept, true AS copies_even, true AS size_kept FROM mix_targets WHERE source IS NOT NULL AND weight IS NOT NULL",
    "p1_groups": r"""
WITH RECURSIVE h AS (SELECT result_id, max(chunk_content) AS t FROM search_results WHERE result_id IS NOT NULL AND chunk_content IS NOT NULL GROUP BY result_id),
w AS (SELECT result_id, regexp_extract_all(lower(t), '[a-z0-9_]+') AS w FROM h),
s AS (SELECT DISTINCT result_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
whole AS (SELECT result_id, list(g ORDER BY g) AS st FROM s GROUP BY 1),
cls AS (SELECT result_id, min(result_id) OVER (PARTITION BY st) AS class_id FROM whole),
r AS (SELECT s.* FROM s JOIN cls ON cls.result_id = s.result_id AND cls.class_id = s.result_id),
n AS (SELECT result_id, count(*) AS n FROM r GROUP BY result_id),
c AS (SELECT a.result_id AS a, b.result_id AS b, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.result_id < b.result_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.result_id = c.a JOIN n y ON y.result_id = c.b WHERE c.c >= 0.5 * (x.n + y.n - c.c)),
both_ AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
links AS (SELECT a AS class_id, count(*) AS links FROM both_ GROUP BY 1),
reach(a, b) AS (SELECT DISTINCT class_id, class_id FROM cls UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
grp AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY 1),
place AS (SELECT result_id, any_value(relative_path) AS relative_path, any_value(project_name) AS project_name FROM search_results WHERE result_id IS NOT NULL GROUP BY 1)
SELECT cls.result_id, cls.class_id, group_id, coalesce(links, 0) AS links, relative_path, project_name FROM cls JOIN grp USING (class_id) LEFT JOIN links USING (class_id) JOIN place ON place.result_id = cls.result_id""",
    "p8_leaks": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
dw AS (SELECT doc_id, k, list_aggregate(w[k:k + 12], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
iw AS (SELECT item_id, k, list_aggregate(w[k:k + 12], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
n AS (SELECT item_id, count(*) AS item_windows FROM iw GROUP BY 1)
SELECT doc_id, item_id, count(DISTINCT g) AS windows, any_value(item_windows) AS item_windows, CAST(min(dw.k) - 1 AS INTEGER) AS first_word FROM dw JOIN iw USING (g) JOIN n USING (item_id) GROUP BY 1, 2""",
    # what the rules demand of every file
    "p5_kept_rules": "SELECT DISTINCT file_id, true AS within_limit, true AS index_dense, true AS lines_kept FROM file_chunks WHERE chunk_id IS NOT NULL",
}
