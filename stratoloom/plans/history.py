"""Change-history queries: an order is a commit, its parts the files, its customer the author."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2000-01-01 00:00:00"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _changes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("subject")
    )


_PAIRS = """WITH c AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS i FROM lineitem), ok AS (SELECT c FROM c GROUP BY c HAVING count(*) <= 50), k AS (SELECT c.* FROM c JOIN ok USING (c)),
 n AS (SELECT i, count(*) AS n FROM k GROUP BY i), j AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS joint FROM k a JOIN k b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2),
 p AS (SELECT j.*, x.n AS n_a, y.n AS n_b FROM j JOIN n x ON x.i = j.item_a JOIN n y ON y.i = j.item_b) """


@query(_PAIRS + "SELECT item_a, item_b, joint, n_a, n_b, round(joint / (n_a + n_b - joint), 9) AS jaccard FROM p WHERE joint / (n_a + n_b - joint) >= 0.03")
def cochange_jaccard(spark: SparkSession, d: str) -> DataFrame:
    p = H.co_change(table(spark, d, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", least_jaccard=0.03)
    return p.withColumn("jaccard", F.round("jaccard", 9))


@query(
    _PAIRS
    + """, t AS (SELECT CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n FROM lineitem)
 SELECT item_a, item_b, round(
 joint / n * log2(joint * n / (n_a * n_b)) + CASE WHEN n_a > joint THEN (n_a - joint) / n * log2((n_a - joint) * n / (n_a * (n - n_b))) ELSE 0 END
 + CASE WHEN n_b > joint THEN (n_b - joint) / n * log2((n_b - joint) * n / ((n - n_a) * n_b)) ELSE 0 END + (n - n_a - n_b + joint) / n * log2((n - n_a - n_b + joint) * n / ((n - n_a) * (n - n_b))), 9) AS mi FROM p CROSS JOIN t WHERE joint >= 2"""
)
def cochange_mi(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    n = li.agg(F.countDistinct("l_orderkey")).first()[0]
    return H.with_mutual_information(H.co_change(li, "l_orderkey", "l_partkey", least_joint=2), n).select("item_a", "item_b", F.round("mi", 9).alias("mi"))


@query(
    f"""SELECT l_partkey AS file, count(DISTINCT o_orderkey) AS commits, count(DISTINCT o_custkey) AS authors,
 round(count(DISTINCT CASE WHEN regexp_matches(o_orderpriority, '(?i)(fix|bug|patch|hotfix|resolve|closes?|fixes)') THEN o_orderkey END) / count(DISTINCT o_orderkey), 6) AS fix_ratio,
 round(count(DISTINCT o_orderkey) / greatest((epoch(TIMESTAMP '{NOW}') - epoch(max(o_orderdate))) / (86400.0 * 30), 1.0), 6) AS churn_rate
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def churn(spark: SparkSession, d: str) -> DataFrame:
    c = H.churn(_changes(spark, d), "file", "commit", "author", "at", "subject", NOW)
    return c.select("file", "commits", "authors", F.round("fix_ratio", 6).alias("fix_ratio"), F.round("churn_rate", 6).alias("churn_rate"))


@query("SELECT o_orderpriority AS area, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS bucket, count(*) AS added FROM orders GROUP BY 1, 2")
def growth_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = H.growth_buckets(table(spark, d, "orders", "o_orderpriority", "o_orderdate"), "o_orderdate", "month", ["o_orderpriority"])
    return g.select(F.col("o_orderpriority").alias("area"), F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "added")


@query("""WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY x) AS i FROM s)
 SELECT l_partkey, count(*) AS n, round(sum(x * x) / (sum(x) * sum(x)), 6) AS hhi, round((2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 6) AS gini FROM r GROUP BY 1""")
def knowledge_silos_hhi_gini(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("x"))
    return H.concentration(s, "l_partkey", "x").select("l_partkey", "n", F.round("hhi", 6).alias("hhi"), F.round("gini", 6).alias("gini"))


@query("""WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
 o AS (SELECT l_partkey, arg_max(l_suppkey, (q, -l_suppkey)) AS owner, arg_max(l_suppkey, (n, -l_suppkey)) AS busiest FROM s GROUP BY 1) SELECT * FROM o WHERE owner <> busiest""")
def ownership_mismatch(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    o = s.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("q", (-F.col("l_suppkey")))).alias("owner"), F.max_by("l_suppkey", F.struct("n", (-F.col("l_suppkey")))).alias("busiest"))
    return o.where("owner <> busiest")


@query("""WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS files, count(DISTINCT l_suppkey) AS modules FROM lineitem GROUP BY 1)
 SELECT l_partkey AS file, count(DISTINCT l.l_orderkey) AS wide_commits, round(avg(c.modules), 6) AS mean_modules FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN c USING (l_orderkey) WHERE c.modules >= 5 GROUP BY 1""")
def shotgun(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    c = li.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("modules")).where("modules >= 5")
    return li.select("l_orderkey", "l_partkey").distinct().join(c, "l_orderkey").groupBy(F.col("l_partkey").alias("file")).agg(F.countDistinct("l_orderkey").alias("wide_commits"), F.round(F.avg("modules"), 6).alias("mean_modules"))


@query("""WITH m AS (SELECT l_partkey AS file, count(*) AS churn, count(DISTINCT l_suppkey) AS coupling, avg(l_discount) AS debt FROM lineitem GROUP BY 1), x AS (SELECT max(churn) AS a, max(coupling) AS b, max(debt) AS c FROM m)
 SELECT file, round(0.4 * churn / a + 0.3 * coupling / b + 0.3 * debt / c, 6) AS pressure FROM m CROSS JOIN x""")
def refactor_pressure(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_discount").groupBy(F.col("l_partkey").alias("file")).agg(F.count(F.lit(1)).alias("churn"), F.countDistinct("l_suppkey").alias("coupling"), F.avg("l_discount").alias("debt"))
    x = m.agg(F.max("churn").alias("a"), F.max("coupling").alias("b"), F.max("debt").alias("c"))
    # one row
    return m.crossJoin(F.broadcast(x)).select("file", F.round(0.4 * F.col("churn") / F.col("a") + 0.3 * F.col("coupling") / F.col("b") + 0.3 * F.col("debt") / F.col("c"), 6).alias("pressure"))


@query("""WITH w AS (SELECT DISTINCT l_partkey AS file, o_custkey AS author, date_trunc('week', o_orderdate) AS week FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 c AS (SELECT file, week, count(*) AS authors FROM w GROUP BY 1, 2) SELECT file, count(*) FILTER (WHERE authors >= 2) AS contested_weeks, max(authors) AS most_authors FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE authors >= 2) > 0""")
def merge_conflict_risk(spark: SparkSession, d: str) -> DataFrame:
    w = _changes(spark, d).select("file", "author", F.date_trunc("week", "at").alias("week")).distinct()
    c = w.groupBy("file", "week").agg(F.count(F.lit(1)).alias("authors"))
    return c.groupBy("file").agg(F.count(F.when(F.col("authors") >= 2, 1)).alias("contested_weeks"), F.max("authors").alias("most_authors")).where("contested_weeks > 0")


@query("""WITH n AS (SELECT project_id, CASE WHEN regexp_matches(x, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(x, '^[a-z]+([A-Z][a-z0-9]*)+$') THEN 'camel' WHEN regexp_matches(x, '^([A-Z][a-z0-9]*)+$') THEN 'pascal' WHEN regexp_matches(x, '^[a-z0-9]+$') THEN 'lower' ELSE 'other' END AS style
 FROM (SELECT DISTINCT file_id, project_id, regexp_extract(relative_path, '([^/.]+)[^/]*$', 1) AS x FROM indexed_files)), c AS (SELECT project_id, style, count(*) AS n FROM n GROUP BY 1, 2)
 SELECT project_id, style, n, CAST(sum(n) OVER (PARTITION BY project_id) AS BIGINT) AS total FROM c QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, style) = 1""")
def naming_mode(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import dominant

    x = F.regexp_extract("relative_path", r"([^/.]+)[^/]*$", 1)
    style = (
        F.when(x.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake").when(x.rlike("^[a-z]+([A-Z][a-z0-9]*)+$"), "camel").when(x.rlike("^([A-Z][a-z0-9]*)+$"), "pascal").when(x.rlike("^[a-z0-9]+$"), "lower").otherwise("other")
    )
    f = table(spark, d, "indexed_files", "file_id", "project_id", "relative_path").distinct().select("file_id", "project_id", x.alias("x"), style.alias("style")).select("file_id", "project_id", "x", "style").distinct()
    return dominant(f, ["project_id"], "style").select("project_id", "style", "n", "total")


@query("""WITH RECURSIVE w AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate) AS t, CAST(count(*) AS DOUBLE) AS x FROM lineitem GROUP BY 1, 2),
 m AS (SELECT k, avg(x) AS mean, greatest(stddev_pop(x), 0.5) AS sigma, count(*) AS n FROM w GROUP BY k HAVING count(*) >= 4),
 r AS (SELECT w.k, w.t, w.x, mean, sigma, row_number() OVER (PARTITION BY w.k ORDER BY w.t) AS i FROM w JOIN m USING (k)),
 s(k, i, s) AS (SELECT k, i, greatest(0, x - mean - 0.5 * sigma) FROM r WHERE i = 1 UNION ALL SELECT r.k, r.i, greatest(0, s.s + r.x - r.mean - 0.5 * r.sigma) FROM s JOIN r ON r.k = s.k AND r.i = s.i + 1),
 p AS (SELECT s.k, r.t, s.s, r.mean, r.sigma FROM s JOIN r USING (k, i) QUALIFY row_number() OVER (PARTITION BY s.k ORDER BY s.s DESC, s.i) = 1)
 SELECT k AS author, strftime(t, '%Y-%m') AS change_at, round(s, 6) AS peak FROM p WHERE s > 4 * sigma * (1 + 1e-9)""")
def cusum_changepoint(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem", "l_suppkey", "l_shipdate").groupBy(F.col("l_suppkey").alias("author"), F.date_trunc("month", "l_shipdate").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    c = H.cusum_change_points(w, "author", "t", "x")
    return c.select("author", F.date_format("change_at", "yyyy-MM").alias("change_at"), F.round("peak", 6).alias("peak"))


@query("""WITH w AS (SELECT o_orderpriority AS module, date_trunc('week', o_orderdate) AS t, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT module, t, epoch(t) / 86400 AS x, sum(n) OVER (PARTITION BY module ORDER BY t) AS y FROM w)
 SELECT module, count(*) AS n, round(regr_slope(y, x), 6) AS slope, CAST(arg_max(y, t) AS BIGINT) AS latest, round((100000 - arg_max(y, t)) / regr_slope(y, x) / 7, 4) AS weeks FROM c GROUP BY 1""")
def module_growth_forecast(spark: SparkSession, d: str) -> DataFrame:
    w = H.growth_buckets(table(spark, d, "orders", "o_orderpriority", "o_orderdate"), "o_orderdate", "week", ["o_orderpriority"])
    # one row a week and module
    c = w.select(F.col("o_orderpriority").alias("module"), (F.unix_timestamp(F.col("bucket").cast("timestamp")) / 86400).alias("x"), F.sum("added").over(Window.partitionBy("o_orderpriority").orderBy("bucket")).alias("y"))
    t = H.linear_trend(c, ["module"], "x", "y")
    return t.select("module", "n", F.round("slope", 6).alias("slope"), "latest", F.round(H.weeks_to(100000, F.col("latest"), F.col("slope")), 4).alias("weeks"))


@query("""WITH m AS (SELECT event_type AS topic, date_trunc('day', ts) AS t, count(*) AS n FROM events GROUP BY 1, 2) SELECT topic, round(regr_slope(n, epoch(t) / 86400), 6) AS slope,
 CASE WHEN regr_slope(n, epoch(t) / 86400) > 0.05 THEN 'emerging' WHEN regr_slope(n, epoch(t) / 86400) < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM m GROUP BY 1""")
def topic_trend_slope(spark: SparkSession, d: str) -> DataFrame:
    m = H.growth_buckets(table(spark, d, "events", "event_type", "ts"), "ts", "day", ["event_type"]).withColumn("x", F.unix_timestamp(F.col("bucket").cast("timestamp")) / 86400)
    t = H.linear_trend(m, ["event_type"], "x", "added")
    return t.select(F.col("event_type").alias("topic"), F.round("slope", 6).alias("slope"), F.when(F.col("slope") > 0.05, "emerging").when(F.col("slope") < -0.05, "declining").otherwise("stable").alias("trend"))
