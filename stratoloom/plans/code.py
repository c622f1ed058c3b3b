"""Queries over code: symbols, calls, impact, ownership, and live streams run to their end."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collectors as K
from ..operators import concurrency as C
from ..operators import quality as Q
from ..operators import symbols as S
from ..operators import text as X
from ..operators import vectors as V
from ..operators.graph import edge_list, simple_paths
from ..operators.imports import resolve_imports
from ..session import Cuts, ship
from ..sources.tables import latest, table
from ..streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return Cuts(spark, "files").cut(latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "project_id", "language", "content"), "file_id", "indexed_at"))


@query()
def symbol_table(spark: SparkSession, d: str) -> DataFrame:
    return S.extract_symbols(_files(spark, d)).where("what = 'def'").drop("what")


@query()
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return S.call_graph(Cuts(spark, "symbols").cut(S.extract_symbols(f)), f)


@query()
def function_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return S.function_metrics(S.extract_symbols(f), f)


def _file_graph(spark: SparkSession, d: str) -> DataFrame:
    f = Cuts(spark, "paths").cut(latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "project_id", "relative_path"), "file_id", "indexed_at"))
    t = latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "language", "content"), "file_id", "indexed_at")
    return Cuts(spark, "file-graph").cut(resolve_imports(X.extract_imports(t, "file_id", "language", "content"), f))


@query()
def file_graph(spark: SparkSession, d: str) -> DataFrame:
    """Imports that lead to files of the same project."""
    return _file_graph(spark, d)


@query()
def unused_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that no call in their project names."""
    f = _files(spark, d)
    return K.unused_functions(Cuts(spark, "symbols").cut(S.extract_symbols(f)), f)


@query()
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that import no file and that no file imports."""
    return K.orphan_files(_file_graph(spark, d), table(spark, d, "indexed_files", "file_id", "relative_path"))


@query(
    rf"""WITH f AS (SELECT file_id AS id, max_by(project_id, indexed_at) AS project_id, lower(max_by(relative_path, indexed_at)) AS path FROM indexed_files WHERE file_id IS NOT NULL GROUP BY 1),
 n AS (SELECT *, regexp_extract(path, '([^/]+?)\.[^/.]*$', 1) AS name, regexp_matches(path, '{K.TEST_PATH}') AS test FROM f WHERE path IS NOT NULL AND project_id IS NOT NULL),
 b AS (SELECT *, regexp_replace(regexp_replace(name, '^tests?_', ''), '(?:[._-](?:test|spec)|tests?)$', '') AS bare FROM n)
 SELECT id, project_id FROM b WHERE NOT test AND bare <> '' AND (project_id, bare) NOT IN (SELECT (project_id, bare) FROM b WHERE test)"""
)
def untested_files(spark: SparkSession, d: str) -> DataFrame:
    """Source files that no test of their project is named after."""
    return K.untested_files(latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "project_id", "relative_path"), "file_id", "indexed_at"))


@query(
    r"""WITH f AS (SELECT file_id AS id, max_by(content, indexed_at) AS content FROM indexed_files GROUP BY 1), w AS (SELECT id, unnest(regexp_extract_all(content, '[A-Za-z_]\w*')) AS w FROM f), c AS (SELECT id, w, count(*) AS n FROM w GROUP BY 1, 2),
 p AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM c) SELECT id, count(*) AS identifiers, round(0 - sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1"""
)
def identifier_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = S.identifier_entropy(_files(spark, d), "file_id", "content")
    return e.withColumn("entropy", F.round("entropy", 6))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey").distinct()
    return edge_list(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS src, id AS dst FROM work_items WHERE parent_id IS NOT NULL), t AS (SELECT min(src) AS t FROM e),
 r(id, h) AS (SELECT t, 0 FROM t UNION SELECT e.dst, r.h + 1 FROM r JOIN e ON e.src = r.id WHERE r.h < 3), m AS (SELECT id, min(h) AS h FROM r GROUP BY 1),
 w AS (SELECT id, project_id FROM work_items GROUP BY 1, 2), s AS (SELECT DISTINCT b.id FROM w a JOIN w b ON a.project_id = b.project_id JOIN t ON a.id = t.t WHERE b.id <> t.t)
 SELECT coalesce(m.id, s.id) AS id, round(CASE WHEN m.h = 1 THEN 1.0 WHEN m.h > 1 THEN 1.0 / (m.h + 1) ELSE 0.8 * 0.5 END, 6) AS score, CASE WHEN m.h IS NOT NULL THEN 'import' ELSE 'co-change' END AS source FROM (SELECT * FROM m WHERE h > 0) m FULL JOIN s ON m.id = s.id WHERE coalesce(m.id, s.id) <> (SELECT t FROM t)"""
)
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "id", "parent_id", "project_id")
    imports = w.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")).distinct()
    target = imports.agg(F.min("dst")).first()[0]
    mine = w.where((F.col("id") == target) & F.col("project_id").isNotNull()).select("project_id").distinct()
    co = w.join(F.broadcast(mine), "project_id").select(F.lit(target).alias("a"), F.col("id").alias("b"), F.lit(0.5).alias("weight")).distinct()
    none = co.where("false")
    return Q.change_impact(imports, co, none, target).withColumn("score", F.round("score", 6))


@query()
def reviewer_recommender(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author")).agg(F.sum("l_quantity").alias("lines"))
    return spark.createDataFrame(Q.reviewers(own, [1, 2, 3, 4, 5, 6], 4), "author long, files int")


@query(
    """WITH RECURSIVE c AS (SELECT id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_id DESC) rn FROM work_items WHERE id IS NOT NULL) WHERE rn = 1),
 ok(id, d) AS (SELECT id, 0 FROM c WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM c) UNION ALL SELECT c.id, d + 1 FROM c JOIN ok ON c.parent_id = ok.id), n AS (SELECT parent_id AS id, count(*) AS noc FROM c WHERE parent_id IN (SELECT id FROM c) GROUP BY 1)
 SELECT ok.id, CAST(d AS INTEGER) AS dit, coalesce(noc, 0) AS noc FROM ok LEFT JOIN n USING (id)"""
)
def inheritance_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth and children of the items that no loop holds."""
    w = latest(table(spark, d, "work_items", "id", "updated_at", "parent_id"), "id", "updated_at")
    return Q.inheritance_depth(w, "id", "parent_id").where("dit is not null")


@query()
def cross_project_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The most similar chunks of other projects for every chunk, at least 0.85."""
    f = table(spark, d, "indexed_files", "file_id", "project_id").groupBy("file_id").agg(F.max("project_id").alias("project_id"))
    c = table(spark, d, "file_chunks", "chunk_id", "file_id", "embedding").where("size(embedding) = 64 and not exists(embedding, x -> isnan(x))")
    c = Cuts(spark, "chunks").cut(c.groupBy("chunk_id").agg(F.max(F.struct("file_id", "embedding")).alias("r")).select(F.col("chunk_id").alias("id"), "r.file_id", F.col("r.embedding").alias("vec")).join(f, "file_id").select("id", "vec", "project_id"))
    k = V.nearest_to_each(c, c, 10, group="project_id", exclude_same_group=True, least=0.85)
    return k.groupBy(F.least("q", "c").alias("chunk_a"), F.greatest("q", "c").alias("chunk_b")).agg(F.max("cosine").alias("similarity"))


@query(
    """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1, 2) SELECT CAST(src AS VARCHAR) || '>' || CAST(dst AS VARCHAR) AS path, w AS weight FROM e WHERE src IN (1, 2) AND src <> dst"""
)
def path_search(spark: SparkSession, d: str) -> DataFrame:
    return simple_paths(_pairs(spark, d), [1, 2], 1).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "weight")


def _locks(spark: SparkSession, d: str) -> DataFrame:
    """An order stands for a function, its parts' brands for locks, taken in line order and never released."""
    li = table(spark, d, "lineitem", F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("seq"), "l_partkey")
    p = table(spark, d, "part", "p_partkey", F.col("p_brand").alias("lock"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("function", "seq", "lock", F.lit("acquire").alias("op"))


@query(
    """WITH a AS (SELECT l_orderkey AS f, l_linenumber AS seq, p_brand AS lock FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT x.lock AS src, y.lock AS dst, count(DISTINCT x.f) AS places FROM a x JOIN a y ON x.f = y.f AND y.seq > x.seq AND x.lock <> y.lock GROUP BY 1, 2"""
)
def lock_order(spark: SparkSession, d: str) -> DataFrame:
    return C.lock_order(_locks(spark, d))


@query("SELECT l_returnflag AS channel, count(*) FILTER (WHERE l_linestatus = 'O') AS sends, count(*) FILTER (WHERE l_linestatus <> 'O') AS receives FROM lineitem GROUP BY 1")
def channel_balance(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", F.col("l_returnflag").alias("channel"), F.when(F.col("l_linestatus") == "O", "send").otherwise("receive").alias("op"))
    return C.channel_balance(li).select("channel", "sends", "receives")


@query(
    """WITH a AS (SELECT DISTINCT topic_id AS concept, unnest(project_names) AS attribute FROM topics), n AS (SELECT concept, count(*) AS n FROM a GROUP BY 1), s AS (SELECT x.concept AS src, y.concept AS dst, count(*) AS c FROM a x JOIN a y ON x.attribute = y.attribute AND x.concept <> y.concept GROUP BY 1, 2),
 sub AS (SELECT src, dst FROM s JOIN n nd ON nd.concept = dst JOIN n ns ON ns.concept = src WHERE c = nd.n AND ns.n > nd.n) SELECT src, dst FROM sub WHERE NOT EXISTS (SELECT 1 FROM sub p JOIN sub q ON p.dst = q.src WHERE p.src = sub.src AND q.dst = sub.dst)"""
)
def is_a_cover(spark: SparkSession, d: str) -> DataFrame:
    return C.is_a_cover(table(spark, d, "topics", F.col("topic_id").alias("concept"), F.explode("project_names").alias("attribute")))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS src, id AS dst FROM work_items WHERE parent_id IS NOT NULL), r(src, dst, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.dst WHERE r.hops < 200),
 own AS (SELECT DISTINCT id AS f, kind AS e FROM work_items WHERE kind IS NOT NULL), x AS (SELECT f, e, 0 AS hops FROM own UNION ALL SELECT r.src, own.e, r.hops FROM r JOIN own ON own.f = r.dst) SELECT f AS function, e AS effect, CAST(min(hops) AS INTEGER) AS hops FROM x GROUP BY 1, 2"""
)
def effect_propagation(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "id", "parent_id", "kind")
    calls = Cuts(spark, "calls").cut(w.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")).distinct())
    return C.effects(calls, w.where("kind is not null").select(F.col("id").alias("function"), F.col("kind").alias("effect")))


#: Files and query files per block of compared texts.
COMPRESSION_BLOCK = (512, 64)


@query()
def compression_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Compression distance of the files with an id divisible by 100 to every other file of their project.

    In blocks of the files by blocks of the query files, so that no task holds a whole project.  A pair
    of two query files comes once, the smaller id first; the query file is ``a`` otherwise.
    """
    f = _files(spark, d).where("content is not null and file_id is not null and project_id is not null")
    n = f.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr("file_id % 100 = 0"), 1)).alias("nq")).where("nq > 0")
    blocks = n.select("project_id", *[F.ceil(F.col(c) / k).cast("int").alias(o) for c, k, o in zip(("n", "nq"), COMPRESSION_BLOCK, ("nb", "nqb"))])
    t = f.join(blocks, "project_id").select("project_id", "file_id", "content", "nb", "nqb")
    own = lambda k: F.pmod(F.xxhash64("file_id"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    base = t.select("project_id", "file_id", "content", F.lit(0).alias("side"), own("nb").alias("block"), each("nqb").alias("qblock"))
    asked = t.where("file_id % 100 = 0").select("project_id", "file_id", "content", F.lit(1).alias("side"), each("nb").alias("block"), own("nqb").alias("qblock"))

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        files, queries = (list(zip(p["file_id"], p["content"])) for p in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]))
        size = {i: Q.compressed_size(text) for i, text in [*files, *queries]}
        out = [(a, b, Q.compression_distance(ca, cb, size[a], size[b])) for a, ca in queries for b, cb in files if a != b and (b % 100 or a < b)]
        return pd.DataFrame(out, columns=["a", "b", "distance"])

    ship(spark)
    return base.unionByName(asked).groupBy("project_id", "block", "qblock").applyInPandas(look, "a long, b long, distance double")


# ---- Structured Streaming, run to the end of what is stored ---------------------
def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = live.read_folder(spark, f"{d}/events.parq*", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def live_buffer_time(spark: SparkSession, d: str) -> DataFrame:
    out = live.run_to_end(live.buffer_time(_stream(spark, d), "event_type", "ts", "6 hours", "value"), f"b{uuid.uuid4().hex}", "complete")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@query(
    """WITH RECURSIVE o AS (SELECT event_id, user_id AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r(k, i, event_id, last, emit) AS (SELECT k, i, event_id, t, true FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, o.event_id, CASE WHEN o.t - r.last >= 36000000000 THEN o.t ELSE r.last END, o.t - r.last >= 36000000000 FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
 SELECT event_id FROM r WHERE emit"""
)
def live_dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    return live.run_to_end(live.dedup_ttl(_stream(spark, d), "user_id", "ts", "event_id", 36000), f"d{uuid.uuid4().hex}").select("event_id")
