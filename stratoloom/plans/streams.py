"""The stream operators over the ``events`` table, and point-in-time queries over work items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bitemporal as B
from ..sources.tables import latest, table
from ..streaming import batch as S

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


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _ttl_sql(key: str, seconds: int) -> str:
    return f"""WITH RECURSIVE o AS (SELECT event_id, {key} AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
 r(k, i, event_id, last, emit) AS (SELECT k, i, event_id, t, true FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, o.event_id, CASE WHEN o.t - r.last >= {seconds * 1_000_000} THEN o.t ELSE r.last END, o.t - r.last >= {seconds * 1_000_000} FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
 SELECT event_id FROM r WHERE emit"""


@query(_ttl_sql("user_id", 36000))
def dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    return S.dedup_ttl(_events(spark, d), ["user_id"], "ts", "event_id", 36000).select("event_id")


@query(_ttl_sql("event_type", 3600))
def throttle_first(spark: SparkSession, d: str) -> DataFrame:
    return S.throttle_first(_events(spark, d), ["event_type"], "ts", "event_id", 3600).select("event_id")


@query("WITH n AS (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) SELECT event_id FROM n WHERE gap IS NULL OR gap >= 43200000000")
def debounce_session(spark: SparkSession, d: str) -> DataFrame:
    return S.debounce(_events(spark, d), ["user_id"], "ts", "event_id", 43200).select("event_id")


@query("SELECT CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS BIGINT) AS buffer, event_id FROM events")
def buffer_count(spark: SparkSession, d: str) -> DataFrame:
    return S.buffer_count(_events(spark, d), ["ts", "event_id"], 100).select("buffer", "event_id")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def buffer_time(spark: SparkSession, d: str) -> DataFrame:
    return S.buffer_time(_events(spark, d), ["event_type"], "ts", "6 hours", "value").select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH RECURSIVE o AS (SELECT event_id, user_id AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r(k, i, event_id, start, cnt, buffer) AS (SELECT k, i, event_id, t, 1, 0 FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, o.event_id, CASE WHEN r.cnt >= 5 OR o.t - r.start >= 86400000000 THEN o.t ELSE r.start END,
 CASE WHEN r.cnt >= 5 OR o.t - r.start >= 86400000000 THEN 1 ELSE r.cnt + 1 END, CASE WHEN r.cnt >= 5 OR o.t - r.start >= 86400000000 THEN r.buffer + 1 ELSE r.buffer END FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
 SELECT event_id, CAST(buffer AS BIGINT) AS buffer FROM r"""
)
def buffer_time_count(spark: SparkSession, d: str) -> DataFrame:
    return S.buffer_time_count(_events(spark, d), ["user_id"], "ts", "event_id", 86400, 5).select("event_id", "buffer")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i = 1 OR p IS DISTINCT FROM event_type")
def distinct_until_changed(spark: SparkSession, d: str) -> DataFrame:
    return S.distinct_until_changed(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def changelog_collapse(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d).withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    return S.collapse_changes(log, "user_id", "event_id", "op").select("user_id", "event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type IN ('click', 'view') ORDER BY event_id LIMIT 250")
def changelog_replay(spark: SparkSession, d: str) -> DataFrame:
    return S.replay(_events(spark, d), "event_id", 500, topics=("event_type", ["click", "view"])).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY")
def telemetry_retention(spark: SparkSession, d: str) -> DataFrame:
    return S.retain(_events(spark, d), "ts", "2024-01-20 00:00:00", 10).select("event_id")


# ---- bitemporal -------------------------------------------------------------
_CUR = "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_id DESC, project_id DESC) rn FROM work_items WHERE id IS NOT NULL) WHERE rn = 1) "


def _work(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "work_items", "id", "updated_at", "parent_id", "project_id", "created_at", "received_at", "weight", "status"), "id", "updated_at")


@query(_CUR + "SELECT id FROM cur WHERE created_at <= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND (updated_at IS NULL OR updated_at > TIMESTAMPTZ '2025-01-01 00:00:00+00') AND received_at <= TIMESTAMPTZ '2025-06-01 00:00:00+00'")
def facts_at(spark: SparkSession, d: str) -> DataFrame:
    at, known = (F.to_timestamp(F.lit(x)) for x in ("2025-01-01 00:00:00", "2025-06-01 00:00:00"))
    return B.facts_at(_work(spark, d), at, known, "created_at", "updated_at", recorded="received_at").select("id")


@query(
    _CUR
    + """, e AS (SELECT 'item:' || parent_id AS src, 'item:' || id AS dst, 'parent' AS kind, weight, true AS open FROM cur WHERE parent_id IS NOT NULL UNION ALL SELECT 'project:' || project_id, 'item:' || id, 'holds', 1.0, true FROM cur WHERE project_id IS NOT NULL
 UNION ALL SELECT 'chunk:' || chunk_id, 'topic:' || topic_id, 'about', membership_score, true FROM assignments WHERE chunk_id IS NOT NULL AND topic_id IS NOT NULL) SELECT src, dst, kind, max(weight) AS weight, bool_or(open) AS open FROM e GROUP BY 1, 2, 3"""
)
def unified_edges_merge(spark: SparkSession, d: str) -> DataFrame:
    w = _work(spark, d)
    a = table(spark, d, "assignments", F.col("chunk_id").alias("src"), F.col("topic_id").alias("dst"), F.col("membership_score").alias("weight"))
    return B.unified_edges(
        [
            (w.select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), "weight"), "parent", "item", "item"),
            (w.select(F.col("project_id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")), "holds", "project", "item"),
            (a, "about", "chunk", "topic"),
        ]
    )


@query(
    """WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, p_retailprice AS sim FROM part ORDER BY rank LIMIT 50), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 50)
 SELECT coalesce(a.id, b.id) AS id, round(coalesce(1 / (60.0 + a.rank), 0) + coalesce(1 / (60.0 + b.rank), 0), 9) AS score, a.sim FROM a FULL JOIN b ON a.id = b.id"""
)
def memory_hybrid(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", F.col("p_partkey").alias("id"), "p_retailprice", "p_size")

    def leg(c: str) -> DataFrame:
        top = p.orderBy(F.desc(c), "id").limit(50)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "id"))).withColumn("sim", F.col("p_retailprice"))

    return B.merge_legs(leg("p_retailprice"), leg("p_size"), "id").select("id", F.round("score", 9).alias("score"), "sim")


@query(_CUR + "SELECT id, round(weight * exp(-ln(2) * date_diff('day', CAST(created_at AT TIME ZONE 'UTC' AS DATE), DATE '2026-01-01') / 90.0), 9) AS faded FROM cur WHERE weight IS NOT NULL AND created_at IS NOT NULL")
def path_weight_decay(spark: SparkSession, d: str) -> DataFrame:
    w = _work(spark, d).where("weight is not null and created_at is not null")
    age = F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("created_at"))
    return w.select("id", F.round(B.aged(F.col("weight"), age, 90.0), 9).alias("faded"))


@query(
    _CUR.replace("WITH cur", "WITH RECURSIVE cur")
    + ", ok(id) AS (SELECT id FROM cur WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM cur) UNION ALL SELECT c.id FROM cur c JOIN ok ON c.parent_id = ok.id) SELECT id FROM cur WHERE id NOT IN (SELECT id FROM ok)"
)
def supersede_cycles(spark: SparkSession, d: str) -> DataFrame:
    return B.supersede_loops(_work(spark, d), "id", "parent_id")
