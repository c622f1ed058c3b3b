"""Filters, sorting, aggregates, joins, windows and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import Fields, combine, glob_match, optional, valid_at, word_boundaries
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..session import broadcast_if_small
from ..sources.tables import table

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


PROPS = Fields("props", {"k": "number"})


def _events(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "events", *cols)


# ---- filters ---------------------------------------------------------------
@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "event_type", "value").where(combine(Fields(), [("event_type", "eq", "click")])).select("event_id", "value")


@query("SELECT event_id FROM events WHERE NOT coalesce(CAST(props->>'$.k' AS DOUBLE) = 69, false)")
def filter_ne_missing(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "props").where(combine(PROPS, [("k", "ne", 69)])).select("event_id")


@query("SELECT event_id, value FROM events WHERE value > 50")
def filter_gt(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "value").where(combine(Fields(), [("value", "gt", 50.0)]))


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS DOUBLE) < 10")
def filter_lt(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "props").where(combine(PROPS, [("k", "lt", 10)])).select("event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id >= 40 AND value >= 1.5")
def filter_gte(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "user_id", "value").where(combine(Fields(), [("user_id", "gte", 40), ("value", "gte", 1.5)])).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-02 00:00:00'")
def filter_lte(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "ts").where(combine(Fields(types={"ts": "timestamp"}), [("ts", "lte", "2024-01-02 00:00:00")])).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), lower('BRASS'))")
def filter_contains_ci(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").where(combine(Fields(), [("p_type", "contains", "BRASS")])).select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def filter_exists_json(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "props").where(combine(PROPS, [("k", "exists")])).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value > 90 OR CAST(props->>'$.k' AS DOUBLE) = 1")
def filter_any_or(spark: SparkSession, d: str) -> DataFrame:
    cond = combine(Fields(), [("event_type", "eq", "error"), ("value", "gt", 90.0)], any_of=True) | combine(PROPS, [("k", "eq", 1)])
    return _events(spark, d, "event_id", "event_type", "value", "props").where(cond).select("event_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\bchunks?\b')")
def filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").where(F.col("text").rlike(word_boundaries(r"\bchunks?\b"))).select("doc_id")


@query("SELECT file_id, relative_path FROM indexed_files WHERE relative_path LIKE 'crates/%/src/%.rs'")
def filter_glob(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files", "file_id", "relative_path").where(glob_match("relative_path", "crates/*/src/*.rs"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'purchase')")
def filter_isin(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_id", "event_type").where(F.col("event_type").isin("view", "purchase"))


@query("SELECT id FROM work_items WHERE kind = 'todo'")
def optional_params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_items", "id", "kind", "status").where(optional("kind", "todo") & optional("status", None)).select("id")


@query("SELECT id, weight FROM work_items WHERE created_at <= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND (updated_at IS NULL OR updated_at > TIMESTAMPTZ '2025-01-01 00:00:00+00')")
def filter_valid_at(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    return table(spark, d, "work_items", "id", "weight", "created_at", "updated_at").where(valid_at(at, "created_at", "updated_at")).select("id", "weight")


@query("SELECT doc_id, round(n_chars / 7.0, 4) AS score FROM documents")
def project_rounded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "n_chars").select("doc_id", F.round(F.col("n_chars") / 7.0, 4).alias("score"))


# ---- sort, page, top-k -----------------------------------------------------
@query("SELECT id, priority, weight FROM work_items ORDER BY weight DESC NULLS LAST, id DESC, priority, updated_at LIMIT 100")
def sort_nulls_last_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "id", "priority", "weight", "updated_at")
    return w.orderBy(F.col("weight").desc_nulls_last(), F.desc("id"), "priority", "updated_at").limit(100).select("id", "priority", "weight")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 100")
def page_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), F.desc("o_orderkey")).offset(100).limit(50)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.top_per_group(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


# ---- aggregates ------------------------------------------------------------
@query("""SELECT event_type, count(*) AS count, count(DISTINCT user_id) AS count_distinct_user_id, round(sum(value), 4) AS sum_value, round(avg(value), 6) AS avg_value,
 round(coalesce(stddev_samp(value), CASE WHEN count(value) = 1 THEN 0.0 END), 6) AS stddev_value, round(median(value), 6) AS median_value, min(value) AS min_value, max(value) AS max_value,
 CAST(0 AS BIGINT) AS n_ignored_value FROM events GROUP BY event_type""")
def agg_all_eight(spark: SparkSession, d: str) -> DataFrame:
    m = [A.Metric("count")] + [A.Metric(f, "value") for f in ("sum", "avg", "stddev", "median", "min", "max")] + [A.Metric("count_distinct", "user_id")]
    out = A.aggregate(_events(spark, d, "event_type", "user_id", "value"), ["event_type"], m)
    return out.withColumns({"sum_value": F.round("sum_value", 4), **{c: F.round(c, 6) for c in ("avg_value", "stddev_value", "median_value")}})


@query("SELECT count(*) AS count, sum(value) AS sum_value, CAST(0 AS BIGINT) AS n_ignored_value FROM events WHERE value > 1e12")
def agg_global_empty(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate(_events(spark, d, "value").where("value > 1e12"), [], [A.Metric("count"), A.Metric("sum", "value")])


@query("SELECT source, count(*) AS count, count(lang) AS count_lang FROM documents GROUP BY source")
def agg_group_null(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate(table(spark, d, "documents", "source", "lang"), ["source"], [A.Metric("count"), A.Metric("count", "lang")])


@query("SELECT doc_kind, CAST(count(TRY_CAST(source AS DOUBLE)) AS DOUBLE) AS sum_source, CAST(count(source) AS BIGINT) AS n_ignored_source FROM documents GROUP BY doc_kind")
def agg_n_ignored(spark: SparkSession, d: str) -> DataFrame:
    out = A.aggregate(table(spark, d, "documents", "doc_kind", "source"), ["doc_kind"], [A.Metric("sum", "source")])
    return out.withColumn("sum_source", F.coalesce("sum_source", F.lit(0.0)))


@query("SELECT props->>'$.k' AS k, count(*) AS count, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def agg_json_key(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d, "props", "value")
    return e.groupBy(PROPS.text("k").alias("k")).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click' AND value > 20) AS big_clicks, count(*) AS n FROM events GROUP BY user_id")
def agg_filter_clause(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "user_id", "event_type", "value").groupBy("user_id").agg(
        F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.count(F.when((F.col("event_type") == "click") & (F.col("value") > 20), 1)).alias("big_clicks"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def agg_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_type", "value").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p)), 6).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_order, max(o_totalprice) AS best_price FROM orders GROUP BY o_custkey")
def agg_argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best_order"), F.max("o_totalprice").alias("best_price"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def agg_ordered_array(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    lst = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return li.groupBy("l_orderkey").agg(F.array_join(F.transform(lst, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'O') AS any_open, bool_and(o_orderstatus = 'F') AS all_done FROM orders GROUP BY o_custkey")
def agg_bool_or(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 10")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers >= 10")


@query("""SELECT event_type AS tool, nullif(CAST(user_id AS VARCHAR), '') AS project, count(*) AS calls, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
 round(count(*) FILTER (WHERE value > 40) / count(*), 6) AS slow_share FROM events GROUP BY 1, 2""")
def telemetry_summary(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "event_type", "user_id", "value").groupBy(F.col("event_type").alias("tool"), F.nullif(F.col("user_id").cast("string"), F.lit("")).alias("project")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg("value"), 6).alias("mean_ms"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95_ms"), F.round(F.count(F.when(F.col("value") > 40, 1)) / F.count(F.lit(1)), 6).alias("slow_share")
    )


@query("""WITH c AS (SELECT r.r_name AS region, n.n_name AS nation, c.c_mktsegment AS segment, c.c_acctbal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
 l3 AS (SELECT region, nation, segment, count(*) n, avg(c_acctbal) m FROM c GROUP BY ALL), l2 AS (SELECT region, nation, count(*) n, avg(m) m FROM l3 GROUP BY ALL), l1 AS (SELECT region, count(*) n, avg(m) m FROM l2 GROUP BY ALL)
 SELECT 'segment' AS level, segment AS key, n AS n_children, round(m + 1e-7, 4) AS c_acctbal FROM l3 UNION ALL SELECT 'nation', nation, n, round(m + 1e-7, 4) FROM l2 UNION ALL SELECT 'region', region, n, round(m + 1e-7, 4) FROM l1
 UNION ALL SELECT 'all', NULL, count(*), round(avg(m) + 1e-7, 4) FROM l1""")
def hierarchy_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_acctbal").join(broadcast_if_small(n), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return A.rollup_means(c, ["region", "nation", "segment"], ["c_acctbal"]).withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1e-7, 4))


@query("SELECT project_id, count(*) AS items, round(sum(weight * CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END) / sum(weight), 6) AS completion FROM work_items GROUP BY project_id")
def weighted_completion(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "project_id", "status", "weight").withColumn("p", F.when(F.col("status") == "done", 1.0).otherwise(0.0))
    return A.weighted_completion(w, ["project_id"], "weight", "p").withColumn("completion", F.round("completion", 6))


# ---- joins -----------------------------------------------------------------
@query("""SELECT n.n_name AS nation, count(*) AS lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""")
def join_inner_star(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").join(F.broadcast(table(spark, d, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("n_name").alias("nation")).agg(F.sum("n").alias("lines"), F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT c.c_custkey, coalesce(o.n, 0) AS orders FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
def join_left_coalesce(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer", "c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


_LEG = "SELECT {id} AS id, row_number() OVER (ORDER BY {by}) AS rank FROM {t} ORDER BY {by} LIMIT 200"
_LEGS = [
    ("part", "p_partkey", ["p_retailprice DESC", "p_partkey"]),
    ("part", "p_partkey", ["p_size DESC", "p_partkey"]),
    ("part", "p_partkey", ["p_name", "p_partkey"]),
]


def _leg(spark: SparkSession, d: str, t: str, key: str, by: list[str]) -> DataFrame:
    order = [F.desc(b.split()[0]) if b.endswith("DESC") else F.asc(b) for b in by]
    top = table(spark, d, t).orderBy(*order).limit(200)
    # the limited leg is ranked in one small partition
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.col(key).alias("id"), "rank")


def _rrf_sql(n: int) -> str:
    legs = ", ".join(f"l{i} AS ({_LEG.format(t=t, id=k, by=', '.join(b))})" for i, (t, k, b) in enumerate(_LEGS[:n]))
    ids = "coalesce(" + ", ".join(f"l{i}.id" for i in range(n)) + ")"
    joins = "l0 FULL OUTER JOIN l1 ON l0.id = l1.id" + (" FULL OUTER JOIN l2 ON coalesce(l0.id, l1.id) = l2.id" if n == 3 else "")
    score = " + ".join(f"coalesce({w} / (60 + l{i}.rank), 0)" for i, w in zip(range(n), (0.5, 0.5, 1.0)))
    legs_n = " + ".join(f"CAST(l{i}.id IS NOT NULL AS INTEGER)" for i in range(n))
    return f"WITH {legs} SELECT {ids} AS id, round({score}, 9) AS score, CAST({legs_n} AS BIGINT) AS legs FROM {joins}"


@query(_rrf_sql(2))
def join_full_rrf2(spark: SparkSession, d: str) -> DataFrame:
    return J.rank_fusion([(_leg(spark, d, *x), w) for x, w in zip(_LEGS[:2], (0.5, 0.5))]).withColumn("score", F.round("score", 9))


@query(_rrf_sql(3))
def join_full_rrf3(spark: SparkSession, d: str) -> DataFrame:
    return J.rank_fusion([(_leg(spark, d, *x), w) for x, w in zip(_LEGS, (0.5, 0.5, 1.0))]).withColumn("score", F.round("score", 9))


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity >= 50)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' AND l_quantity >= 50")
    return table(spark, d, "supplier", "s_suppkey", "s_name").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer", "c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT s_suppkey, round(s_acctbal / (SELECT avg(s_acctbal) FROM supplier), 6) AS ratio FROM supplier")
def join_cross_scalar(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", "s_suppkey", "s_acctbal")
    # the other side is one row
    return s.crossJoin(F.broadcast(s.agg(F.avg("s_acctbal").alias("m")))).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("m"), 6).alias("ratio"))


@query("""WITH p AS (SELECT DISTINCT result_id, path, start_line FROM search_results WHERE start_line IS NOT NULL),
 c AS (SELECT DISTINCT f.path, k.chunk_id, k.start_line AS s, k.end_line AS e FROM file_chunks k JOIN (SELECT DISTINCT file_id, path FROM indexed_files) f USING (file_id))
 SELECT p.result_id, c.chunk_id FROM p JOIN c ON p.path = c.path AND p.start_line BETWEEN c.s AND c.e""")
def join_range_contains(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "search_results", "result_id", "path", "start_line").where("start_line is not null").distinct()
    f = table(spark, d, "indexed_files", "file_id", "path").distinct()
    c = table(spark, d, "file_chunks", "chunk_id", "file_id", F.col("start_line").alias("s"), F.col("end_line").alias("e")).distinct().join(f, "file_id").select("path", "chunk_id", "s", "e")
    return J.contains_join(p, c, "path", "start_line", "s", "e").select("result_id", "chunk_id")


@query("""SELECT a.l_partkey AS part_a, b.l_partkey AS part_b, count(DISTINCT a.l_orderkey) AS orders FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
 GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2""")
def join_self_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey").distinct()
    b = li.select("l_orderkey", F.col("l_partkey").alias("part_b"))
    pairs = li.join(b, "l_orderkey").where("l_partkey < part_b")
    return pairs.groupBy(F.col("l_partkey").alias("part_a"), "part_b").agg(F.count(F.lit(1)).alias("orders")).where("orders >= 2")


@query("""WITH e AS (SELECT parent_id AS src, id AS dst FROM (SELECT DISTINCT id, parent_id FROM work_items) WHERE parent_id IS NOT NULL)
 SELECT w.id, count(*) AS degree FROM (SELECT DISTINCT id FROM work_items) w JOIN e ON e.src = w.id OR e.dst = w.id GROUP BY w.id""")
def join_undirected(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "id", "parent_id").distinct()
    e = J.undirected(w.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")))
    return w.select("id").distinct().join(e, F.col("id") == F.col("src")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@query("""WITH f AS (SELECT DISTINCT f.file_id, f.project_id, p.git_common_dir AS repo, f.relative_path FROM indexed_files f JOIN projects p USING (project_id))
 SELECT file_id FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.repo = f.repo AND g.relative_path = f.relative_path AND g.project_id < f.project_id)""")
def dedup_repo_path(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "projects", "project_id", F.col("git_common_dir").alias("repo"))
    f = table(spark, d, "indexed_files", "file_id", "project_id", "relative_path").distinct().join(p, "project_id")
    return J.drop_worktree_copies(f).select("file_id")


@query("""SELECT l.event_id, r.event_id AS last_error FROM events l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts) r
 ON l.user_id = r.user_id AND l.ts >= r.ts WHERE l.event_type = 'click'""")
def asof_validity(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d, "event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("last_error"))
    return J.as_of_join(left, right, ["user_id"], "ts", "rts", ["last_error"]).select("event_id", "last_error")


@query("""WITH s AS (SELECT DISTINCT result_id, path, relative_path, project_name FROM search_results), f AS (SELECT path, min(file_id) AS t FROM indexed_files GROUP BY path),
 g AS (SELECT relative_path, min(CAST(file_id AS VARCHAR)) AS t FROM indexed_files GROUP BY relative_path)
 SELECT s.result_id, coalesce(CAST(f.t AS VARCHAR), g.t) AS target, CAST(CASE WHEN f.t IS NOT NULL THEN 0 WHEN g.t IS NOT NULL THEN 1 END AS INTEGER) AS phase FROM s LEFT JOIN f USING (path) LEFT JOIN g USING (relative_path)""")
def join_resolution_phases(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_results", "result_id", "path", "relative_path").distinct()
    f = table(spark, d, "indexed_files", "file_id", "path", "relative_path")
    return J.first_match(s, "result_id", [(f, ["path"], "file_id"), (f, ["relative_path"], "file_id")]).select("result_id", "target", "phase")


# ---- windows ---------------------------------------------------------------
@query("""WITH d AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), r AS (SELECT l_partkey, n, percent_rank() OVER (ORDER BY n) AS pr FROM d)
 SELECT l_partkey, n, round(pr, 6) AS percent_rank FROM r WHERE pr <= 0.1""")
def percent_rank_zombie(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem", "l_partkey").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return W.percent_rank(n, "n").where("percent_rank <= 0.1").withColumn("percent_rank", F.round("percent_rank", 6))


@query("""WITH p AS (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey), r AS (SELECT l_partkey, percent_rank() OVER (ORDER BY n) AS a, percent_rank() OVER (ORDER BY q) AS b FROM p)
 SELECT l_partkey, round(a * b, 6) AS heat FROM r WHERE a >= 0.9 AND b >= 0.9""")
def hot_path(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    r = W.percent_rank(W.percent_rank(p, "n", "a"), "q", "b")
    return r.where("a >= 0.9 AND b >= 0.9").select("l_partkey", F.round(F.col("a") * F.col("b"), 6).alias("heat"))


@query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2) SELECT src, dst, w FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 5""")
def fanout_cap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem", "l_suppkey", "l_partkey").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("w"))
    return W.top_per_group(e, ["src"], [F.desc("w"), F.col("dst")], 5)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
 SELECT user_id, event_type, n, CAST(total AS BIGINT) AS total, round(n / total, 6) AS share FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def dominant_category(spark: SparkSession, d: str) -> DataFrame:
    return W.dominant(_events(spark, d, "user_id", "event_type"), ["user_id"], "event_type").withColumn("share", F.round("share", 6))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return W.first_per_key(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running_total FROM events")
def running_total(spark: SparkSession, d: str) -> DataFrame:
    r = W.running_total(_events(spark, d, "event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return r.select("event_id", F.round("running_total", 4).alias("running_total"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY source, lang) AS dup_count FROM documents")
def dup_count(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "lang")
    n = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("dup_count")).select(F.col("source").alias("s"), F.col("lang").alias("l"), "dup_count")
    return docs.join(F.broadcast(n), docs.source.eqNullSafe(F.col("s")) & docs.lang.eqNullSafe(F.col("l"))).select("doc_id", "dup_count")


@query("""WITH c AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(q) OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey ROWS UNBOUNDED PRECEDING) AS run, sum(q) OVER (PARTITION BY l_partkey) AS total FROM c)
 SELECT l_partkey, 1 + count(*) FILTER (WHERE run < 0.5 * total - 1e-9) AS bus_factor FROM r GROUP BY l_partkey""")
def bus_factor_cumulative(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.history import bus_factor

    c = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return bus_factor(c, "l_partkey", "l_suppkey", "q", 0.5).select("l_partkey", "bus_factor")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(date_trunc('day', ts) AS DATE) - DATE '2024-01-01' AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
 SELECT user_id, CAST(min(day) AS INTEGER) AS first, CAST(max(day) AS INTEGER) AS last, count(*) AS length FROM i GROUP BY user_id, g""")
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d, "user_id", "ts").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    return W.gaps_and_islands(e, ["user_id"], "day")


# ---- set operations --------------------------------------------------------
@query("SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all_edges(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect_dependents(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_partkey", "l_returnflag")
    return li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(li.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def except_unused(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 49").select(F.col("l_partkey").alias("k"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).join(used, "k", "left_anti").distinct()
