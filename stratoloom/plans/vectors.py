"""Vector queries over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import vectors as V
from ..operators.graph import connected_components
from ..session import Cuts
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: A fixed query vector.
QUERY = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_Q = "[" + ", ".join(repr(x) for x in QUERY) + "]"
_E = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings) "
_K = """, s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.v, b.v) AS cosine, a.label AS la, b.label AS lb FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 k AS (SELECT q, c, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS rank FROM s) """


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(_E + f"SELECT vec_id, round(list_cosine_similarity(v, {_Q}), 6) AS score FROM e ORDER BY list_cosine_similarity(v, {_Q}) DESC, vec_id LIMIT 10")
def knn_query(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest_to(_emb(spark, d), QUERY, 10, "id", "vec").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(_E + _K + "SELECT q, c, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5 AND q % 100 = 0")
def knn_per_row(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return V.nearest_to_each(e.where("id % 100 = 0"), e, 5).withColumn("cosine", F.round("cosine", 6))


@query(
    _E
    + """, s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.v, b.v) AS cosine FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.label <> b.label),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS rank FROM s) SELECT least(q, c) AS id_a, greatest(q, c) AS id_b, round(max(cosine), 6) AS cosine FROM k WHERE rank <= 10 AND cosine >= 0.2 GROUP BY 1, 2"""
)
def knn_threshold_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    k = V.nearest_to_each(e.where("id % 100 = 0"), e, 10, group="label", exclude_same_group=True).where("cosine >= 0.2")
    return k.groupBy(F.least("q", "c").alias("id_a"), F.greatest("q", "c").alias("id_b")).agg(F.round(F.max("cosine"), 6).alias("cosine"))


@query(_E + _K + ", n AS (SELECT k.*, x.label AS la, y.label AS lb FROM k JOIN e x ON x.vec_id = q JOIN e y ON y.vec_id = c WHERE rank <= 20 AND q % 100 = 0) SELECT least(la, lb) AS file_a, greatest(la, lb) AS file_b, round(max(cosine), 6) AS weight FROM n WHERE la <> lb GROUP BY 1, 2")
def file_pair_max(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return _file_pairs(e, e.where("id % 100 = 0"))


@query()
def file_pair_max_all(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`file_pair_max`, from the neighbours of all rows."""
    e = _emb(spark, d)
    return _file_pairs(e, e)


def _file_pairs(e: DataFrame, queries: DataFrame) -> DataFrame:
    k = V.nearest_to_each(queries, e, 20)
    lab = e.select("id", "label")
    n = k.join(lab.select(F.col("id").alias("q"), F.col("label").alias("la")), "q").join(lab.select(F.col("id").alias("c"), F.col("label").alias("lb")), "c").where("la <> lb")
    return n.groupBy(F.least("la", "lb").alias("file_a"), F.greatest("la", "lb").alias("file_b")).agg(F.round(F.max("cosine"), 6).alias("weight"))


_CENT = ", p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM m GROUP BY 1) "


@query(_E + _CENT + "SELECT m.label, CAST(m.pos - 1 AS INTEGER) AS pos, round(m.m, 6) AS mean FROM m")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    return V.centroids(_emb(spark, d), "label", "vec").select("label", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id < (SELECT max(vec_id) / 2 FROM embeddings) THEN label * 2 ELSE label * 2 + 1 END AS label FROM embeddings) "
    + _CENT
    + "SELECT CAST(a.label // 2 AS INTEGER) AS label, round(1 - list_cosine_similarity(a.centroid, b.centroid), 6) AS drift FROM c a JOIN c b ON a.label % 2 = 0 AND b.label = a.label + 1"
)
def semantic_drift(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    half = e.agg((F.max("id") / 2).alias("h"))
    # one row
    parts = e.crossJoin(F.broadcast(half)).withColumn("part", F.col("label") * 2 + F.when(F.col("id") < F.col("h"), 0).otherwise(1))
    c = V.centroids(parts, "part", "vec")
    a, b = c.where("part % 2 = 0").select("part", F.col("centroid").alias("ca")), c.select((F.col("part") - 1).alias("part"), F.col("centroid").alias("cb"))
    return a.join(b, "part").select((F.col("part") / 2).cast("int").alias("label"), F.round(1 - cosine("ca", "cb"), 6).alias("drift"))


@query(
    _E
    + _CENT
    + """, s AS (SELECT vec_id, e.label, 1 - list_cosine_similarity(v, centroid) AS d FROM e JOIN c ON e.label = c.label), z AS (SELECT label, avg(d) AS m, stddev_pop(d) AS sd FROM s GROUP BY 1)
 SELECT vec_id, round((d - m) / sd, 5) AS z FROM s JOIN z ON s.label = z.label WHERE (d - m) / sd > 1.5"""
)
def anomaly_z(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    s = e.join(F.broadcast(V.centroids(e, "label", "vec").select("label", "centroid")), "label").select("id", "label", (1 - cosine("vec", "centroid")).alias("d"))
    z = s.groupBy("label").agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("sd"))
    return s.join(F.broadcast(z), "label").withColumn("z", (F.col("d") - F.col("m")) / F.col("sd")).where("z > 1.5").select(F.col("id").alias("vec_id"), F.round("z", 5).alias("z"))


@query(
    _E
    + _K
    + """, n AS (SELECT q, c, 1 - cosine AS d FROM k WHERE rank <= 10), kd AS (SELECT q AS c, max(d) AS kd FROM n GROUP BY q), l AS (SELECT q, 1 / greatest(avg(greatest(d, kd)), 1e-12) AS lrd FROM n JOIN kd USING (c) GROUP BY q)
 SELECT n.q AS vec_id, round(avg(lc.lrd) / any_value(lq.lrd), 5) AS lof FROM n JOIN l lc ON lc.q = n.c JOIN l lq ON lq.q = n.q GROUP BY n.q"""
)
def lof(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    k = Cuts(spark, "lof").cut(V.nearest_to_each(e, e, 10))
    return V.local_outlier_factors(k, 10).select(F.col("id").alias("vec_id"), F.round("lof", 5).alias("lof"))


@query(_E + ", m AS (SELECT a.vec_id AS a, max(list_cosine_similarity(a.v, b.v)) AS best FROM e a JOIN e b ON a.label = 0 AND b.label = 1 GROUP BY 1) SELECT count(*) AS rows, round(avg(best), 6) AS mean_best, round(max(best), 6) AS max_best, round(min(best), 6) AS min_best FROM m")
def compare_pair(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    m = V.nearest_to_each(e.where("label = 0"), e.where("label = 1"), 1)
    return m.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("cosine"), 6).alias("mean_best"), F.round(F.max("cosine"), 6).alias("max_best"), F.round(F.min("cosine"), 6).alias("min_best"))


@query(_E + _CENT + "SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.centroid, b.centroid), 6) AS cosine FROM c a JOIN c b ON a.label < b.label")
def best_match_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = Cuts(spark, "labels").cut(V.centroids(_emb(spark, d), "label", "vec").select("label", "centroid"))
    b = c.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    return c.join(b, F.col("label") < F.col("b")).select(F.col("label").alias("a"), "b", F.round(cosine("centroid", "cb"), 6).alias("cosine"))


@query()
def simhash_lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.simhash_pairs(V.simhash_signatures(_emb(spark, d), "id", "vec"), "id", most_distance=20)


@query(
    "WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND (a.vec_id % 100 = 0 OR b.vec_id % 100 = 0) AND list_cosine_similarity(a.v, b.v) >= 0.35),"
    " r(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT a AS vec_id, min(b) AS component FROM r GROUP BY a"
)
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    k = V.nearest_to_each(e.where("id % 100 = 0"), e, None, least=0.35)
    return connected_components(k, "q", "c").select(F.col("id").alias("vec_id"), "component")


@query()
def duplicate_components_all(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`duplicate_components`, with the links between all rows."""
    return V.similarity_components(_emb(spark, d), 0.35).select(F.col("id").alias("vec_id"), "component")


@query()
def mmr(spark: SparkSession, d: str) -> DataFrame:
    return V.mmr(_emb(spark, d), QUERY, 20, "id", "vec")
