"""Topic analytics and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import collectors as K
from ..operators import quality as Q
from ..operators import text as X
from ..operators import topics as T
from ..session import Cuts
from ..sources.tables import latest, table

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


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """Chunk, topic, file, project: every assignment once."""
    f = table(spark, d, "indexed_files", "file_id", "project_id").groupBy("file_id").agg(F.max("project_id").alias("project_id"))
    c = table(spark, d, "file_chunks", "chunk_id", "file_id").distinct()
    return table(spark, d, "assignments", "chunk_id", "topic_id").distinct().join(c, "chunk_id").join(f, "file_id")


_A = """WITH f AS (SELECT file_id, max(project_id) AS project_id FROM indexed_files GROUP BY 1), c AS (SELECT DISTINCT chunk_id, file_id FROM file_chunks), a AS (SELECT DISTINCT chunk_id, topic_id FROM assignments),
 x AS (SELECT a.chunk_id, a.topic_id, f.project_id, c.file_id FROM a JOIN c USING (chunk_id) JOIN f USING (file_id)), h AS (SELECT project_id, topic_id, count(*) AS n FROM x WHERE project_id IS NOT NULL AND topic_id IS NOT NULL GROUP BY 1, 2) """


@query(_A + "SELECT project_id, topic_id, n, round(n / sum(n) OVER (PARTITION BY project_id), 6) AS share FROM h")
def project_topic_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.topic_histogram(_assigned(spark, d), "project_id").withColumn("share", F.round("share", 6))


@query(
    _A
    + """, p AS (SELECT project_id, n, n / sum(n) OVER (PARTITION BY project_id) AS p, row_number() OVER (PARTITION BY project_id ORDER BY n) AS i FROM h)
 SELECT project_id, count(*) AS kinds, round(0 - sum(p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) >= 2 THEN 1 + sum(p * ln(p)) / ln(count(*)) ELSE 1 END, 6) AS specialisation, round(sum(p * p), 6) AS hhi,
 round(greatest(0, least(1, (2 * sum(i * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)))), 6) AS gini FROM p GROUP BY 1"""
)
def project_topic_profile(spark: SparkSession, d: str) -> DataFrame:
    p = T.topic_profile(T.topic_histogram(_assigned(spark, d), "project_id"), "project_id")
    return p.select("project_id", "kinds", *[F.round(c, 6).alias(c) for c in ("entropy", "specialisation", "hhi", "gini")])


@query(_A + "SELECT p.topic_id AS topic_a, q.topic_id AS topic_b, count(*) AS groups, CAST(sum(least(p.n, q.n)) AS BIGINT) AS weight FROM h p JOIN h q ON p.project_id = q.project_id AND p.topic_id < q.topic_id GROUP BY 1, 2")
def topic_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return T.co_occurrence(T.topic_histogram(_assigned(spark, d), "project_id"), "project_id")


@query(_A + ", m AS (SELECT project_id, sqrt(sum(n * n)) AS norm FROM h GROUP BY 1) SELECT p.project_id AS a, q.project_id AS b, round(sum(p.n * q.n) / (any_value(x.norm) * any_value(y.norm)), 6) AS cosine FROM h p JOIN h q ON p.topic_id = q.topic_id AND p.project_id < q.project_id JOIN m x ON x.project_id = p.project_id JOIN m y ON y.project_id = q.project_id GROUP BY 1, 2 HAVING sum(p.n * q.n) / (any_value(x.norm) * any_value(y.norm)) >= 0.3")
def project_topic_similarity(spark: SparkSession, d: str) -> DataFrame:
    return T.group_similarity(T.topic_histogram(_assigned(spark, d), "project_id"), "project_id", 0.3).withColumn("cosine", F.round("cosine", 6))


@query(_A + "SELECT 'orphans' AS kind, file_id AS key, count(*) AS n FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM a WHERE chunk_id IS NOT NULL) GROUP BY 2 UNION ALL SELECT 'thin topic', CAST(topic_id AS BIGINT), count(DISTINCT chunk_id) FROM a GROUP BY 2 HAVING count(DISTINCT chunk_id) < 5")
def topic_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return T.coverage_gaps(table(spark, d, "file_chunks", "chunk_id", "file_id"), table(spark, d, "assignments", "chunk_id", "topic_id").distinct())


@query(_A + ", t AS (SELECT topic_id, sum(n) AS t, count(*) AS groups, arg_max(project_id, (n, -project_id)) AS top_group, max(n) AS m FROM h GROUP BY 1) SELECT topic_id, groups, top_group, round(m / t, 6) AS top_share FROM t")
def topic_project_map(spark: SparkSession, d: str) -> DataFrame:
    return T.top_share_map(T.topic_histogram(_assigned(spark, d), "project_id"), "project_id").withColumn("top_share", F.round("top_share", 6))


@query("""WITH r AS (SELECT t.chunk_count AS stored, t.topic_id, count(DISTINCT a.chunk_id) AS n FROM (SELECT topic_id, max(chunk_count) AS chunk_count FROM topics GROUP BY 1) t LEFT JOIN assignments a USING (topic_id) GROUP BY ALL) SELECT topic_id, stored, n AS current, n - stored AS change FROM r""")
def topic_size_change(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics", "topic_id", "chunk_count").groupBy("topic_id").agg(F.max("chunk_count").alias("stored"))
    n = table(spark, d, "assignments", "chunk_id", "topic_id").groupBy("topic_id").agg(F.countDistinct("chunk_id").alias("current"))
    return t.join(n, "topic_id", "left").select("topic_id", "stored", F.coalesce("current", F.lit(0)).alias("current"), (F.coalesce("current", F.lit(0)) - F.col("stored")).alias("change"))


@query()
def topic_coherence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "file_chunks", "chunk_id", "content").where("content is not null").groupBy("chunk_id").agg(F.max("content").alias("content"))
    words = X.identifier_terms(c, [F.col("chunk_id").alias("doc")], "content")
    labels = table(spark, d, "topics", F.col("topic_id").alias("topic"), F.explode("keywords").alias("word")).distinct()
    return T.npmi(words, labels)


@query("WITH l AS (SELECT DISTINCT topic_id, unnest(keywords) AS word FROM topics) SELECT round(count(DISTINCT word) / count(*), 6) AS diversity FROM l")
def topic_diversity(spark: SparkSession, d: str) -> DataFrame:
    return T.diversity(table(spark, d, "topics", "topic_id", F.explode("keywords").alias("word")).distinct()).select(F.round("diversity", 6).alias("diversity"))


# ---- quality ------------------------------------------------------------------
_F = """WITH f AS (SELECT file_id, max_by(content, indexed_at) AS content, max_by(line_count, indexed_at) AS lines, max_by(language, indexed_at) AS language FROM indexed_files GROUP BY 1),
 m AS (SELECT file_id, CAST(lines AS DOUBLE) AS lines, len(regexp_extract_all(content, '\\b(if|for|while|match|case|switch)\\b')) * 1.0 AS cyc, len(regexp_extract_all(content, '\\b(?:TODO|FIXME|HACK|XXX)\\b')) AS markers FROM f WHERE content IS NOT NULL AND lines IS NOT NULL) """


def _measures(spark: SparkSession, d: str) -> DataFrame:
    f = latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "content", "line_count"), "file_id", "indexed_at").where("content is not null and line_count is not null")
    n = lambda p: F.size(F.regexp_extract_all("content", F.lit(p), F.lit(0)))
    return f.select("file_id", F.col("line_count").cast("double").alias("lines"), n(r"\b(if|for|while|match|case|switch)\b").cast("double").alias("cyc"), n(r"\b(?:TODO|FIXME|HACK|XXX)\b").alias("markers"))


@query(
    _F
    + """, s AS (SELECT file_id, indexed_at, bool_or(regexp_matches(coalesce(content, ''), '(?i)(fix|bug)')) AS fix FROM indexed_files GROUP BY 1, 2), h AS (SELECT file_id, count(*) AS states, count(*) FILTER (WHERE fix) / count(*) AS fix_share FROM s GROUP BY 1)
 SELECT file_id, round(0.3 * CASE WHEN lines > 0 THEN markers / (lines / 1000) ELSE 0 END + 0.25 * least(cyc / 20, 1) + 0.2 * least(states, 10) / 10 + 0.15 * fix_share + 0.1 * least(lines / 1000, 1), 6) AS debt FROM m JOIN h USING (file_id)"""
)
def technical_debt(spark: SparkSession, d: str) -> DataFrame:
    """Debt of every file; its states in the index stand for its changes, those that speak of fixes for fixes."""
    s = table(spark, d, "indexed_files", "file_id", "indexed_at", "content").groupBy("file_id", "indexed_at").agg(F.bool_or(F.coalesce("content", F.lit("")).rlike("(?i)(fix|bug)")).alias("fix"))
    h = s.groupBy("file_id").agg(F.count(F.lit(1)).alias("states"), F.avg(F.col("fix").cast("double")).alias("fix_share"))
    m = _measures(spark, d).join(h, "file_id")
    return m.select("file_id", F.round(Q.technical_debt(F.col("markers"), F.col("lines"), F.col("cyc"), F.col("states"), F.col("fix_share")), 6).alias("debt"))


@query(_F + ", x AS (SELECT max(cyc) AS a, max(lines) AS b, max(markers) AS c FROM m) SELECT file_id, round(0.5 * cyc / a + 0.4 * lines / b + 0.1 * CASE WHEN c > 0 THEN markers / c ELSE 0 END, 6) AS score FROM m CROSS JOIN x")
def complexity_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return Q.hot_spots(_measures(spark, d), {"cyc": 0.5, "lines": 0.4, "markers": 0.1}).select("file_id", F.round("score", 6).alias("score"))


@query(_F + "SELECT file_id, round(least(171, greatest(0, 171 - 5.2 * ln(greatest(lines * greatest(log2(greatest(lines, 1)), 1), 1)) - 0.23 * cyc - 16.2 * ln(greatest(lines, 1)))) * 100 / 171, 4) AS mi FROM m")
def maintainability_index(spark: SparkSession, d: str) -> DataFrame:
    return _measures(spark, d).select("file_id", F.round(Q.maintainability(F.col("lines"), F.col("cyc")), 4).alias("mi"))


@query(
    """WITH e AS (SELECT DISTINCT a.kind AS src, b.kind AS dst FROM work_items a JOIN work_items b ON b.parent_id = a.id), x AS (SELECT DISTINCT kind AS src, 'todo' AS dst FROM work_items)
 SELECT coalesce(e.src, x.src) AS src, coalesce(e.dst, x.dst) AS dst, CASE WHEN e.src IS NOT NULL AND x.src IS NOT NULL THEN 'convergence' WHEN e.src IS NOT NULL THEN 'divergence' ELSE 'absence' END AS verdict FROM e FULL JOIN x ON e.src = x.src AND e.dst = x.dst"""
)
def architecture_reflexion(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "id", "parent_id", "kind")
    actual = w.select(F.col("id").alias("p"), F.col("kind").alias("src")).join(w.select(F.col("parent_id").alias("p"), F.col("kind").alias("dst")), "p").select("src", "dst")
    return Q.reflexion(w.select(F.col("kind").alias("src"), F.lit("todo").alias("dst")), actual)


@query("""WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), p AS (SELECT *, q / sum(q) OVER (PARTITION BY l_suppkey) AS p FROM s) SELECT l_suppkey, count(*) AS edges, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def import_entropy(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return Q.edge_entropy(s, "l_suppkey", "q").withColumn("entropy", F.round("entropy", 6))


def _current(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "content"), "file_id", "indexed_at")


def _findings_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    rows = " UNION ALL ".join(f"SELECT id, '{name}' AS collector, '{pillar}' AS pillar, CAST(len(regexp_extract_all(content, {quoted(p)})) AS INTEGER) AS hits FROM f" for name, (pillar, p) in K.FINDINGS.items())
    return f"WITH f AS (SELECT file_id AS id, max_by(content, indexed_at) AS content FROM indexed_files WHERE file_id IS NOT NULL GROUP BY 1), x AS ({rows}), hit AS (SELECT * FROM x WHERE hits > 0)"


@query(_findings_sql() + " SELECT id, collector, pillar, hits FROM hit")
def code_findings(spark: SparkSession, d: str) -> DataFrame:
    """What the collectors find in the current files."""
    return K.pattern_findings(_current(spark, d))


@query(
    _findings_sql()
    + """, s AS (SELECT pillar, collector, 100.0 * (1 - count(*) FILTER (WHERE hits > 0) / (SELECT count(*) FROM f WHERE content IS NOT NULL)) AS score FROM x GROUP BY 1, 2), p AS (SELECT pillar, avg(score) AS score FROM s GROUP BY 1), a AS (SELECT * FROM p UNION ALL SELECT 'overall', avg(score) FROM p)
 SELECT pillar, round(score, 5) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM a"""
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """The grades of the pillars over what the collectors find."""
    return Q.grade_report(K.pillar_scores(Cuts(spark, "current").cut(_current(spark, d)))).withColumn("score", F.round("score", 5))


@query("""SELECT severity, kind, key, message FROM (SELECT 1 AS severity, 'loop' AS kind, CAST(id AS VARCHAR) AS key, 'its own parent' AS message FROM (SELECT DISTINCT id FROM work_items WHERE id = parent_id)
 UNION ALL SELECT 2, 'no text', CAST(file_id AS VARCHAR), 'content left on disk' FROM (SELECT file_id FROM indexed_files GROUP BY file_id HAVING max(content) IS NULL))""")
def alert_digest(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "work_items", "id", "parent_id").where("id = parent_id").select(F.col("id").alias("key"), F.lit("its own parent").alias("message")).distinct()
    f = table(spark, d, "indexed_files", "file_id", "content").groupBy(F.col("file_id").alias("key")).agg(F.max(F.col("content").isNotNull()).alias("has")).where("not has").select("key", F.lit("content left on disk").alias("message"))
    return Q.digest([(w, "loop", 1), (f, "no text", 2)])


@query()
def query_correction(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt queries put right by a bigram model of the documents."""
    words = table(spark, d, "documents", "text").where("text is not null").select(TX.tokens("text").alias("words"))
    queries = ["serch reslts", "topc of the qeue", "chunks of the inedx"]
    model = Q.BigramModel(Cuts(spark, "ngrams").cut(Q.ngram_counts(words, 2)), queries)
    return spark.createDataFrame([(q, " ".join(model.correct(q.split()))) for q in queries], "query string, corrected string")
