"""Clustering, reduction, outliers, defect models and series neighbours over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning as M
from ..operators import vector_trees as W
from ..operators import vectors as V
from ..session import Cuts, few_or_raise
from ..sources.tables import table


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def fcm_memberships(spark: SparkSession, d: str) -> DataFrame:
    """Memberships of every vector in ten fuzzy clusters."""
    return M.fuzzy_c_means(_emb(spark, d), "id", "vec", 10)[0]


def kmeans_pp(spark: SparkSession, d: str) -> DataFrame:
    """Starting centres drawn by distance."""
    c = M.kmeans_pp(M.bounded_sample(_emb(spark, d), "id", "vec"), 10)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "cluster int, centre array<double>")


def k_selection(spark: SparkSession, d: str) -> DataFrame:
    """Xie-Beni index per number of clusters."""
    x = M.bounded_sample(_emb(spark, d), "id", "vec")
    return spark.createDataFrame(M.sweep_k(x, [5, 10, 15, 20]), "k int, xie_beni double")


def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters per label."""
    return M.hdbscan(_emb(spark, d), "label", "id", "vec")


def pca_project(spark: SparkSession, d: str) -> DataFrame:
    """The vectors on their first eight principal axes."""
    return M.principal_components(_emb(spark, d), "id", "vec", 8)


def random_projection(spark: SparkSession, d: str) -> DataFrame:
    """The vectors in sixteen random directions."""
    return M.random_projection(_emb(spark, d), "id", "vec", 16)


def _part_features(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_suppkey", "l_returnflag")
    return li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.countDistinct("l_suppkey").alias("s"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"))


def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    """Outlier scores of parts by their order lines."""
    return M.isolation_scores(_part_features(spark, d), "l_partkey", ["n", "q", "disc", "tax", "s"])


def logistic_defect(spark: SparkSession, d: str) -> DataFrame:
    """Probability that a part is returned more often than a third, per brand."""
    f = _part_features(spark, d).join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).withColumn("y", (F.col("returned") > 1 / 3).cast("int"))
    return M.logistic_by_group(f, "p_brand", "l_partkey", ["n", "q", "disc", "tax", "s"], "y")


def msm_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five customers whose quarterly orders move most like those of each customer."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey", F.date_trunc("quarter", "o_orderdate").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: x["n"]).alias("v"))
    s = Cuts(spark, "series").cut(s)
    return M.series_neighbours(s, s, "o_custkey", "v", 5)


def summary_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The tree of summaries over all vectors, from the root down."""
    return W.summary_tree(_emb(spark, d))[0].drop("vec")


def summary_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nodes of the tree, of whatever level, that are most like the vector with the smallest id."""
    nodes = Cuts(spark, "summaries").cut(W.summary_tree(_emb(spark, d))[0])
    return W.summary_search(nodes, _emb(spark, d).agg(F.min_by("vec", "id").alias("v")).first().v, 10)


def label_dendrogram(spark: SparkSession, d: str) -> DataFrame:
    """The labels merged two at a time by the average cosine distance of their mean vectors."""
    c = V.centroids(_emb(spark, d), "label", "vec")
    return spark.createDataFrame(W.merge_order(c, "label", "centroid"), f"step int, a {dict(c.dtypes)['label']}, b {dict(c.dtypes)['label']}, distance double, size int")


def online_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Centres of ten clusters after the vectors of every label came as a batch of their own."""
    e = Cuts(spark, "stream").cut(_emb(spark, d))
    model = W.OnlineClusters(M.kmeans_pp(M.bounded_sample(e, "id", "vec"), 10))
    for r in sorted(few_or_raise(e.select("label").distinct(), 1000, "labels"), key=lambda r: str(r.label)):
        model.update(e.where(F.col("label") == r.label))
    return spark.createDataFrame([(i, float(w), [float(x) for x in c]) for i, (w, c) in enumerate(zip(model.weights, model.centres))], "cluster int, weight double, centre array<double>")


QUERIES = {f.__name__: f for f in (fcm_memberships, kmeans_pp, k_selection, hdbscan, pca_project, random_projection, isolation_forest, logistic_defect, msm_knn, summary_nodes, summary_search, label_dendrogram, online_clusters)}
SQL: dict[str, str] = {}
