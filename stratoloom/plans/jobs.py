"""Batch derivations: functions from folders of tables to folders of tables.

Each reads Parquet tables, computes, and overwrites its outputs; running one again gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import history as H
from ..operators import symbols as SY
from ..operators import text as X
from ..operators import topics as T
from ..operators import vectors as V
from ..session import Cuts
from ..sources.readers import changed_files, scan_workspace
from ..sources.sinks import upsert
from ..sources.tables import latest, table
from ..streaming.batch import retain


def _write(df, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def index_workspace(spark: SparkSession, root: str, known: str | None, out: str) -> None:
    """Scan a folder, keep what changed since ``known`` (a folder of an earlier run), cut it into chunks."""
    found = Cuts(spark, "scan").cut(scan_workspace(spark, root))
    fresh = found if known is None else changed_files(found, table(spark, known, "files", "path", "content_hash"))
    files = found if known is None else upsert(table(spark, known, "files"), fresh, ["path"])
    _write(files, out, "files")
    _write(X.line_windows(fresh, "path", "content"), out, "chunks")
    _write(X.extract_imports(fresh, "path", "language", "content"), out, "imports")


def analyse_graph(spark: SparkSession, folder: str, out: str) -> None:
    """Symbols, calls and file-level graph measures of the indexed files."""
    cuts = Cuts(spark, "graph-job")
    files = cuts.cut(latest(table(spark, folder, "indexed_files", "file_id", "indexed_at", "project_id", "language", "content"), "file_id", "indexed_at"))
    symbols = cuts.cut(SY.extract_symbols(files))
    calls = cuts.cut(SY.call_graph(symbols, files))
    _write(symbols, out, "symbols")
    _write(calls, out, "calls")
    owner = lambda c: F.split(c, ":")[0].cast("long")
    edges = cuts.cut(G.edge_list(calls.where("callee is not null").select(owner("caller").alias("src"), owner("callee").alias("dst")).where("src <> dst")))
    measures = G.degrees(edges).join(G.pagerank(edges, iterations=30), "id", "left").join(G.connected_components(edges), "id", "left")
    _write(measures, out, "file_metrics")


def label_topics(spark: SparkSession, folder: str, out: str, words: int = 10) -> None:
    """Keywords, sizes and project profiles of the assigned topics."""
    chunks = table(spark, folder, "file_chunks", "chunk_id", "file_id", "content").where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("file_id", "content")).alias("r")).select("chunk_id", "r.*")
    assigned = Cuts(spark, "topic-job").cut(table(spark, folder, "assignments", "chunk_id", "topic_id", "membership_score").distinct())
    w = X.identifier_terms(chunks.where("content is not null"), ["chunk_id"], "content").groupBy("chunk_id", "word").agg(F.count(F.lit(1)).alias("n"))
    weighted = w.join(assigned, "chunk_id").select(F.col("topic_id").alias("class"), "word", (F.col("membership_score") * F.col("n")).alias("weight"))
    _write(X.class_tf_idf(weighted, words), out, "topic_words")
    files = table(spark, folder, "indexed_files", "file_id", "project_id").groupBy("file_id").agg(F.max("project_id").alias("project_id"))
    h = T.topic_histogram(assigned.select("chunk_id", "topic_id").distinct().join(chunks.select("chunk_id", "file_id"), "chunk_id").join(files, "file_id"), "project_id")
    _write(T.topic_profile(h, "project_id"), out, "project_profiles")
    _write(T.co_occurrence(h, "project_id"), out, "topic_cooccurrence")


def scan_similarity(spark: SparkSession, folder: str, out: str, known: str | None = None, k: int = 10, least: float = 0.85) -> None:
    """Most similar chunks of other projects for every chunk; the greatest similarity of a pair is kept."""
    f = table(spark, folder, "indexed_files", "file_id", "project_id").groupBy("file_id").agg(F.max("project_id").alias("project_id"))
    c = table(spark, folder, "file_chunks", "chunk_id", "file_id", "embedding").where("embedding is not null and not exists(embedding, x -> isnan(x))")
    c = Cuts(spark, "scan-job").cut(c.where("size(embedding) = 64").groupBy("chunk_id").agg(F.max(F.struct("file_id", "embedding")).alias("r")).select(F.col("chunk_id").alias("id"), "r.file_id", F.col("r.embedding").alias("vec")).join(f, "file_id").select("id", "vec", "project_id"))
    hits = V.nearest_to_each(c, c, k, group="project_id", exclude_same_group=True, least=least)
    pairs = hits.groupBy(F.least("q", "c").alias("chunk_a"), F.greatest("q", "c").alias("chunk_b")).agg(F.max("cosine").alias("similarity"))
    if known is not None:
        pairs = upsert(table(spark, known, "similar_chunks"), pairs, ["chunk_a", "chunk_b"], keep="similarity")
    _write(pairs, out, "similar_chunks")


def measure_history(spark: SparkSession, folder: str, out: str, now: str) -> None:
    """Churn, co-change and ownership from ``commits`` and ``commit_files``."""
    commits = table(spark, folder, "commits", "commit_id", "author", "author_date", "subject")
    ch = Cuts(spark, "history-job").cut(table(spark, folder, "commit_files", "commit_id", "file_path").distinct().join(commits, "commit_id"))
    _write(H.churn(ch, "file_path", "commit_id", "author", "author_date", "subject", now), out, "churn")
    _write(H.co_change(ch, "commit_id", "file_path", least_joint=2), out, "co_change")
    shares = ch.groupBy("file_path", "author").agg(F.countDistinct("commit_id").cast("double").alias("n"))
    _write(H.bus_factor(shares, "file_path", "author", "n", 0.5), out, "ownership")


def apply_retention(spark: SparkSession, folder: str, name: str, ts: str, now: str, days: int, out: str) -> None:
    """A log without what is older than ``days`` days."""
    _write(retain(table(spark, folder, name), ts, now, days), out, name)
