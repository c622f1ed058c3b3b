"""Graph queries: parts that follow each other in an order, and the parent links of work items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import graph_local as L
from ..session import Cuts
from ..sources.tables import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
ITERATIONS = 20


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return Cuts(spark, "edges").cut(G.edge_list(li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Parent to child, within the project of the child."""
    w = table(spark, d, "work_items", "id", "parent_id", "project_id").where("parent_id is not null").distinct()
    return Cuts(spark, "tree").cut(w.select(F.coalesce("project_id", F.lit(-1)).alias("project_id"), F.col("parent_id").alias("src"), F.col("id").alias("dst")))


_E = """WITH RECURSIVE x AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
 e AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM x WHERE dst IS NOT NULL GROUP BY 1, 2), n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
_T = "WITH RECURSIVE t AS (SELECT DISTINCT coalesce(project_id, -1) AS project_id, parent_id AS src, id AS dst FROM work_items WHERE parent_id IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM t), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


@query(_E + " SELECT n.id, CAST(coalesce(i.w, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.w, 0) AS BIGINT) AS out_degree FROM n LEFT JOIN (SELECT dst AS id, sum(w) w FROM e GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, sum(w) w FROM e GROUP BY 1) o USING (id)")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    return G.degrees(e)


def _rank_sql(personal: bool) -> str:
    seeds = "(1, 2, 3)"
    s = f"CASE WHEN n.id IN {seeds} THEN 1.0 / 3 ELSE 0 END" if personal else "1.0 / (SELECT count(*) FROM n)"
    q = _E + f", o AS MATERIALIZED (SELECT src, sum(w) AS out FROM e GROUP BY 1), p AS MATERIALIZED (SELECT e.src, e.dst, w / out AS p FROM e JOIN o USING (src)), r0 AS MATERIALIZED (SELECT n.id, CAST({s} AS DOUBLE) AS rank FROM n)"
    for i in range(ITERATIONS):
        q += (
            f", r{i + 1} AS MATERIALIZED (SELECT n.id, 0.15 * ({s}) + 0.85 * (coalesce(f.x, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) * ({s})) AS rank FROM n"
            f" LEFT JOIN (SELECT p.dst AS id, sum(p.p * r.rank) AS x FROM p JOIN r{i} r ON r.id = p.src GROUP BY 1) f ON f.id = n.id)"
        )
    return q + f" SELECT id, round(rank, 9) AS rank FROM r{ITERATIONS}"


@query(_rank_sql(False))
def pagerank_20it(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(_edges(spark, d), iterations=ITERATIONS, tolerance=0.0).withColumn("rank", F.round("rank", 9))


@query(_rank_sql(True))
def personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(_edges(spark, d), iterations=ITERATIONS, tolerance=0.0, seeds=[1, 2, 3]).withColumn("rank", F.round("rank", 9))


def _spread_sql() -> str:
    q = _E + ", b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e WHERE src <> dst), t AS (SELECT src, greatest(sum(w), 1e-12) AS t FROM b GROUP BY 1), p AS MATERIALIZED (SELECT b.src, b.dst, w / t AS p FROM b JOIN t USING (src)), r0 AS (SELECT id, CASE WHEN id IN (1, 2) THEN 0.5 ELSE 0 END AS rank FROM n)"
    for i in range(25):
        q += f", r{i + 1} AS MATERIALIZED (SELECT n.id, 0.85 * coalesce(f.x, 0) + 0.15 * CASE WHEN n.id IN (1, 2) THEN 0.5 ELSE 0 END AS rank FROM n LEFT JOIN (SELECT p.dst AS id, sum(p.p * r.rank) AS x FROM p JOIN r{i} r ON r.id = p.src GROUP BY 1) f ON f.id = n.id)"
    return q + " SELECT id, round(rank, 9) AS rank FROM r25"


@query(_spread_sql())
def ppr_25it(spark: SparkSession, d: str) -> DataFrame:
    return G.spreading_rank(_edges(spark, d), [1, 2]).select("id", F.round("rank", 9).alias("rank"))


def _hits_sql(k: int) -> str:
    q = _E + ", h0 AS (SELECT id, 1.0 AS h FROM n)"
    for i in range(k):
        q += f", ua{i} AS MATERIALIZED (SELECT n.id, coalesce(x, 0) AS a FROM n LEFT JOIN (SELECT dst AS id, sum(w * h) AS x FROM e JOIN h{i} h ON h.id = e.src GROUP BY 1) USING (id)), a{i} AS MATERIALIZED (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM ua{i}) AS a FROM ua{i})"
        q += f", uh{i} AS MATERIALIZED (SELECT n.id, coalesce(x, 0) AS h FROM n LEFT JOIN (SELECT src AS id, sum(w * a) AS x FROM e JOIN a{i} a ON a.id = e.dst GROUP BY 1) USING (id)), h{i + 1} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM uh{i}) AS h FROM uh{i})"
    return q + f" SELECT a.id, round(a, 8) AS authority, round(h, 8) AS hub FROM a{k - 1} a JOIN h{k} h ON a.id = h.id"


@query(_hits_sql(10))
def hits_10it(spark: SparkSession, d: str) -> DataFrame:
    return G.hits(_edges(spark, d), 10).select("id", F.round("authority", 8).alias("authority"), F.round("hub", 8).alias("hub"))


@query(_T + ", b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, b.dst FROM r JOIN b ON b.src = r.b) SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def components(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(_tree(spark, d))


@query(_T + ", r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT n.id, least(n.id, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = n.id), n.id)) AS component FROM n")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(_tree(spark, d))


@query(_E + ", r(id, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.id WHERE r.hops < 2) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY id")
def bfs_khop(spark: SparkSession, d: str) -> DataFrame:
    return G.bfs(_edges(spark, d), [1], 2)


@query(_T + ", r(src, dst, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.dst WHERE r.hops < 200) SELECT src, dst, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1, 2")
def closure(spark: SparkSession, d: str) -> DataFrame:
    return G.transitive_closure(_tree(spark, d))


@query(
    _E
    + """, p(path, last, hops, weight) AS (SELECT [src, dst], dst, 1, w FROM e WHERE src = 1 AND dst <> 1 UNION ALL SELECT list_append(path, e.dst), e.dst, hops + 1, weight * w FROM p JOIN e ON e.src = p.last WHERE hops < 2 AND NOT list_contains(path, e.dst))
 SELECT array_to_string(path, '>') AS path, CAST(hops AS INTEGER) AS hops, weight FROM p"""
)
def path_enum(spark: SparkSession, d: str) -> DataFrame:
    return G.simple_paths(_edges(spark, d), [1], 2).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "weight")


@query()
def path_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The 50 strongest routes of up to four hops from node 1, each edge weighted by its share of its source's weight."""
    e = _edges(spark, d)
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    share = e.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))
    seeds = spark.createDataFrame([(1, 1.0)], "id long, w double")
    return G.ranked_paths(share, seeds, 4, 1e-6, 50).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "flow", "rank")


@query()
def kcore(spark: SparkSession, d: str) -> DataFrame:
    return G.k_core(_edges(spark, d))


_U = _E + ", u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), v AS MATERIALIZED (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u)"


@query(_U + ", g AS (SELECT x AS id, count(*) AS degree FROM v GROUP BY 1), t AS (SELECT p.x AS id, count(*) AS n FROM v p JOIN v q ON q.x = p.x AND p.y < q.y JOIN u ON u.a = p.y AND u.b = q.y GROUP BY 1) SELECT g.id, coalesce(t.n, 0) AS triangles, degree FROM g LEFT JOIN t USING (id)")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return G.triangles(_edges(spark, d))


@query(
    _E
    + """, s AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst), two AS MATERIALIZED (SELECT p.src AS a, p.dst AS b, q.dst AS c FROM s p JOIN s q ON q.src = p.dst AND q.dst <> p.src)
 SELECT 'chain' AS motif, count(*) AS n FROM two UNION ALL SELECT 'fan_out', count(*) FROM s p JOIN s q ON p.src = q.src AND p.dst < q.dst UNION ALL SELECT 'fan_in', count(*) FROM s p JOIN s q ON p.dst = q.dst AND p.src < q.src
 UNION ALL SELECT 'feed_forward', count(*) FROM two JOIN s ON s.src = a AND s.dst = c UNION ALL SELECT 'cycle', count(*) FROM two JOIN s ON s.src = c AND s.dst = a WHERE a < b AND a < c"""
)
def motifs(spark: SparkSession, d: str) -> DataFrame:
    return G.motif_census(_edges(spark, d))


@query(_T + ", r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM r) AS reachable, round((SELECT count(*) FROM r) / ((SELECT count(*) FROM n) * (SELECT count(*) FROM n)), 9) AS propagation_cost")
def dsm_propagation(spark: SparkSession, d: str) -> DataFrame:
    e = _tree(spark, d).select("src", "dst").distinct()
    n = e.select("src").union(e.select("dst")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    r = G.transitive_closure(e).agg(F.count(F.lit(1)).alias("reachable"))
    # both sides are one row
    return n.crossJoin(r).select("nodes", "reachable", F.round(F.col("reachable") / (F.col("nodes") * F.col("nodes")), 9).alias("propagation_cost"))


@query()
def wl_hash2(spark: SparkSession, d: str) -> DataFrame:
    labels = G.wl_labels(_tree(spark, d), 2)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first")).select("first", "members")


@query(
    _U
    + """, q AS (SELECT id FROM n WHERE id % 100 = 0), r(s, id, hops) AS (SELECT id, id, 0 FROM q UNION SELECT r.s, v.y, r.hops + 1 FROM r JOIN v ON v.x = r.id WHERE r.hops < 6), m AS (SELECT s, id, min(hops) AS h FROM r GROUP BY 1, 2)
 SELECT q.id, round(coalesce(sum(CASE WHEN h > 0 THEN 1.0 / h END), 0) / ((SELECT count(*) FROM n) - 1), 8) AS harmonic FROM q LEFT JOIN m ON m.s = q.id GROUP BY q.id"""
)
def harmonic(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    q = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().where("id % 100 = 0")
    return G.harmonic_centrality(e, q).select("id", F.round("harmonic", 8).alias("harmonic"))


@query()
def harmonic_all(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`harmonic`, for all nodes."""
    return G.harmonic_centrality(_edges(spark, d)).select("id", F.round("harmonic", 8).alias("harmonic"))


@query(
    """WITH m AS (SELECT id, any_value(project_id) AS module FROM work_items WHERE project_id IS NOT NULL GROUP BY id HAVING count(DISTINCT project_id) = 1), e AS (SELECT DISTINCT parent_id AS src, id AS dst FROM work_items WHERE parent_id IS NOT NULL),
 x AS (SELECT src, dst, a.module AS ms, b.module AS md FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.module <> b.module), ca AS (SELECT md AS module, count(DISTINCT src) AS ca FROM x GROUP BY 1), ce AS (SELECT ms AS module, count(DISTINCT dst) AS ce FROM x GROUP BY 1)
 SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END, 6) AS instability FROM (SELECT DISTINCT module FROM m) LEFT JOIN ca USING (module) LEFT JOIN ce USING (module)"""
)
def module_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "id", "parent_id", "project_id")
    m = w.where("project_id is not null").groupBy("id").agg(F.min("project_id").alias("module"), F.countDistinct("project_id").alias("n")).where("n = 1")
    e = w.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return G.module_metrics(e, m).withColumn("instability", F.round("instability", 6))


def _same_brand(spark: SparkSession, d: str) -> DataFrame:
    """The edges between parts of one brand, by brand: graphs with cycles and triangles of a size for one worker."""
    brand = Cuts(spark, "brands").cut(table(spark, d, "part", "p_partkey", "p_brand"))
    e = _edges(spark, d).join(brand.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("brand")), "src")
    return Cuts(spark, "brand-edges").cut(e.join(brand.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("brand")), ["dst", "brand"]).select("brand", "src", "dst"))


def _local(func, schema: str):
    return lambda spark, d: L.per_group(_same_brand(spark, d), "brand", func, schema)


#: The edges of :func:`_same_brand`; undirected, simple ones; and both directions of these with degrees.
_B = (
    _E
    + """, be AS MATERIALIZED (SELECT a.p_brand AS brand, src, dst FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst AND a.p_brand = b.p_brand), bu AS MATERIALIZED (SELECT DISTINCT brand, least(src, dst) AS a, greatest(src, dst) AS b FROM be WHERE src <> dst),
 bv AS MATERIALIZED (SELECT brand, a AS x, b AS y FROM bu UNION ALL SELECT brand, b, a FROM bu), bd AS MATERIALIZED (SELECT brand, x, count(*) AS d FROM bv GROUP BY 1, 2), bn AS MATERIALIZED (SELECT DISTINCT brand, unnest([src, dst]) AS id FROM be)"""
)


for _name, _func, _schema in (
    ("louvain", L.louvain, "id long, community long"),
    ("articulation", L.articulation, "kind string, a long, b long"),
    ("dominators", L.dominators, "id long, dominator long"),
    ("spectral", L.spectral, "nodes int, lambda2 double"),
    ("min_cut", L.min_cut, "nodes int, weight double"),
    ("ktruss", L.k_truss, "a long, b long, truss int"),
    ("simple_cycles", L.simple_cycles, "cycle string, length int"),
    ("two_edge_components", L.two_edge_components, "id long, component long"),
    ("attack_simulation", L.attack, "removed int, largest int"),
    ("core_periphery", L.core_periphery, "id long, role string"),
    ("local_centralities", L.centralities, "id long, closeness double, eigenvector double, katz double"),
):
    QUERIES[_name] = _local(_func, _schema)


@query(_B + ", g AS (SELECT bv.brand, p.d AS p, q.d AS q FROM bv JOIN bd p ON p.brand = bv.brand AND p.x = bv.x JOIN bd q ON q.brand = bv.brand AND q.x = bv.y) SELECT brand, CAST(count(*) / 2 AS INTEGER) AS edges, round(CASE WHEN stddev_pop(p) > 0 THEN corr(p, q) END, 6) AS r FROM g GROUP BY 1")
def degree_assortativity(spark: SparkSession, d: str) -> DataFrame:
    return L.per_group(_same_brand(spark, d), "brand", L.assortativity, "edges int, r double").where("edges > 0").select("brand", "edges", F.round(F.nanvl("r", F.lit(None)), 6).alias("r"))


@query(
    _B
    + """, p AS MATERIALIZED (SELECT bv.brand, bv.x AS i, bv.y AS j, 1.0 / d AS p FROM bv JOIN bd ON bd.brand = bv.brand AND bd.x = bv.x), ind AS (SELECT a.brand, a.i, b.j, sum(a.p * b.p) AS s FROM p a JOIN p b ON a.brand = b.brand AND a.j = b.i GROUP BY 1, 2, 3),
 c AS (SELECT p.brand, p.i, sum(power(p.p + coalesce(ind.s, 0), 2)) AS c FROM p LEFT JOIN ind ON ind.brand = p.brand AND ind.i = p.i AND ind.j = p.j GROUP BY 1, 2) SELECT bn.brand, bn.id, round(coalesce(c.c, 0), 6) AS "constraint" FROM bn LEFT JOIN c ON c.brand = bn.brand AND c.i = bn.id"""
)
def burt_constraint(spark: SparkSession, d: str) -> DataFrame:
    return L.per_group(_same_brand(spark, d), "brand", L.constraint, "id long, constraint double").withColumn("constraint", F.round("constraint", 6))


@query(_B + " SELECT brand, count(*) AS edges, count(DISTINCT src) AS sources FROM be GROUP BY 1")
def brand_graph_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the graphs that the algorithms within a worker run on."""
    return _same_brand(spark, d).groupBy("brand").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths through each part within its brand, the sources spread over tasks."""
    return L.per_sources(_same_brand(spark, d), "brand", L.betweenness, "id long, score double", ["id"], "score")


@query()
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths over each edge within a brand, the sources spread over tasks."""
    return L.per_sources(_same_brand(spark, d), "brand", L.edge_betweenness, "a long, b long, score double", ["a", "b"], "score")


@query(
    """WITH m AS (SELECT id, any_value(project_id) AS module FROM work_items WHERE project_id IS NOT NULL GROUP BY id HAVING count(DISTINCT project_id) = 1), e AS (SELECT DISTINCT parent_id AS src, id AS dst FROM work_items WHERE parent_id IS NOT NULL),
 x AS (SELECT src, dst, a.module AS ms, b.module AS md FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.module <> b.module), ca AS (SELECT md AS module, count(DISTINCT src) AS ca FROM x GROUP BY 1), ce AS (SELECT ms AS module, count(DISTINCT dst) AS ce FROM x GROUP BY 1),
 i AS (SELECT module, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END AS instability FROM (SELECT DISTINCT module FROM m) LEFT JOIN ca USING (module) LEFT JOIN ce USING (module)),
 f AS (SELECT file_id, max_by(project_id, indexed_at) AS module, max_by(content, indexed_at) AS content FROM indexed_files GROUP BY 1),
 t AS (SELECT module, sum(len(regexp_extract_all(content, '\b(?:trait|interface)[ \t]+[A-Za-z_]'))) AS abstract, sum(len(regexp_extract_all(content, '\b(?:trait|interface|struct|class|enum|record)[ \t]+[A-Za-z_]'))) AS total FROM f GROUP BY 1)
 SELECT module, round(coalesce(CASE WHEN total > 0 THEN abstract / total END, 0), 6) AS abstractness, round(instability, 6) AS instability, round(abs(coalesce(CASE WHEN total > 0 THEN abstract / total END, 0) + instability - 1), 6) AS distance FROM i LEFT JOIN t USING (module)"""
)
def main_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Abstractness, instability and their distance from the balance, per project: types from the files, links from the work items."""
    w = table(spark, d, "work_items", "id", "parent_id", "project_id")
    m = w.where("project_id is not null").groupBy("id").agg(F.min("project_id").alias("module"), F.countDistinct("project_id").alias("n")).where("n = 1")
    metrics = G.module_metrics(w.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")), m)
    f = latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "project_id", "content"), "file_id", "indexed_at")
    n = lambda p: F.sum(F.size(F.regexp_extract_all("content", F.lit(p + r"[ \t]+[A-Za-z_]"), F.lit(0))))
    types = f.where("content is not null").groupBy(F.col("project_id").alias("module")).agg(n(r"\b(?:trait|interface)").alias("abstract"), n(r"\b(?:trait|interface|struct|class|enum|record)").alias("total"))
    out = G.main_sequence(metrics, types)
    return out.select("module", *[F.round(c, 6).alias(c) for c in ("abstractness", "instability", "distance")])
