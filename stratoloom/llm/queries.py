"""Queries over the code-and-knowledge tables with production parameters, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Cuts
from ..sources.tables import latest, table
from .chunk_split import rechunk, split_oversized
from .clusters import similarity_clusters
from .leakage import find_leaks
from .mixing import count_tokens, mix
from .near_duplicates import CODE_WORD, duplicate_groups, expand_pairs, near_duplicates
from .neighbours import mutual_pairs, nearest_neighbours, usable_vectors
from .origin import flag_not_handwritten
from .parse_check import flag_unparsable, parse_rates
from .sentences import split_sentences


# 1. near-duplicate search hits
def _hits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    hits = table(spark, folder, "search_results", "result_id", "chunk_content")
    return near_duplicates(hits, "result_id", "chunk_content", k=3, threshold=0.5, word=CODE_WORD)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of search hits whose sets of three-token runs share at least half of their union."""
    return expand_pairs(*_hits(spark, folder), "result_id").select("result_id_a", "result_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every hit with its group of near duplicates and where it lies."""
    where = table(spark, folder, "search_results", "result_id", "relative_path", "project_name").where("result_id is not null")
    where = where.groupBy("result_id").agg(F.max(F.struct("relative_path", "project_name")).alias("w")).select("result_id", "w.*")
    return duplicate_groups(*_hits(spark, folder), "result_id").join(where, "result_id")


# 2. files that do not parse
def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "indexed_files", "file_id", "project_id", "language", "content", "indexed_at")
    return latest(flag_unparsable(files, keep=("file_id", "project_id", "language", "indexed_at")), "file_id", "indexed_at")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current files that a parser of their language refuses."""
    return _parsed(spark, folder).where("unparsable").select("file_id")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of refused files per project and language."""
    names = table(spark, folder, "projects", "project_id", "name").groupBy("project_id").agg(F.max("name").alias("project_name"))
    rates = parse_rates(_parsed(spark, folder).withColumn("language", F.lower(F.trim("language"))), "project_id", "language")
    return rates.join(names, "project_id", "left")


# 3. files nobody wrote by hand for their project
def _origins(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "indexed_files", "file_id", "project_id", "relative_path", "language", "content", "indexed_at", "duplicate_of_file_id")
    return flag_not_handwritten(files, table(spark, folder, "projects", "project_id", "git_root_commits"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current files that are generated, minified, vendored or data."""
    return _origins(spark, folder).where("origin is not null").select("file_id")


def p3_origins(spark: SparkSession, folder: str) -> DataFrame:
    """Every current file with its origin, ``handwritten`` for what is left."""
    return _origins(spark, folder).withColumn("origin", F.coalesce("origin", F.lit("handwritten")))


def p3_shared_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Files below directories that unrelated repositories share, by the number of these and the origin given."""
    return p3_origins(spark, folder).where("shared_by > 0").groupBy("shared_by", "origin").agg(F.count("*").alias("files"))


# 5. oversized chunks
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over 4,096 bytes with the number of their lines that alone have more."""
    chunks = table(spark, folder, "file_chunks", "chunk_id", "file_id", "chunk_index", "content", "start_line")
    return split_oversized(chunks).where("piece = 0").select("chunk_id", "long_lines")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks, oversized ones in pieces, numbered densely per file."""
    return rechunk(table(spark, folder, "file_chunks", "chunk_id", "file_id", "chunk_index", "content", "start_line", "end_line"))


def p5_kept_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the chunks of each file keep the rules: none too long, an index without gaps, lines in order."""
    p = p5_pieces(spark, folder)
    dense = (F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count("*") - 1) & (F.countDistinct("chunk_index") == F.count("*"))
    ordered = F.bool_and(F.coalesce(F.col("end_line") >= F.col("start_line"), F.lit(True)))
    return p.groupBy("file_id").agg((F.coalesce(F.max(F.octet_length("content")), F.lit(0)) <= 4096).alias("within_limit"), dense.alias("index_dense"), ordered.alias("lines_kept"))


# 6. clusters of similar chunks
def _vectors(spark: SparkSession, folder: str, label: str) -> DataFrame:
    return Cuts(spark, label).cut(usable_vectors(table(spark, folder, "file_chunks", "chunk_id", "embedding"), "chunk_id", "embedding"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of clusters of at least five chunks."""
    c = similarity_clusters(_vectors(spark, folder, "p6"))
    return c.where("cluster_size >= 5").select(F.col("id").alias("chunk_id"), "cluster_key")


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster of at least five chunks: size, most typical chunks, and the stored topic that fits it best."""
    c = Cuts(spark, "p6c").cut(similarity_clusters(_vectors(spark, folder, "p6")).where("cluster_size >= 5"))
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("density"), "id"))
    typical = c.withColumn("n", rank).where("n <= 5").groupBy("cluster_key", "cluster_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("typical_chunks"))
    stored = table(spark, folder, "assignments", "chunk_id", "topic_id", "membership_score").distinct()
    per = c.select(F.col("id").alias("chunk_id"), "cluster_key").join(stored, "chunk_id").groupBy("cluster_key", "topic_id").agg(F.countDistinct("chunk_id").alias("n"), F.avg("membership_score").alias("mean_score"))
    best = per.groupBy("cluster_key").agg(F.max(F.struct("n", (-F.col("topic_id")).alias("t"), "mean_score")).alias("b"))
    best = best.select("cluster_key", (-F.col("b.t")).alias("topic_id"), F.col("b.n").alias("topic_chunks"), F.col("b.mean_score").alias("mean_score"))
    counts = table(spark, folder, "topics", "topic_id", "chunk_count").groupBy("topic_id").agg(F.max("chunk_count").alias("stored_chunk_count"))
    return typical.join(best, "cluster_key", "left").join(counts, "topic_id", "left").select("cluster_key", "cluster_size", "typical_chunks", "topic_id", "topic_chunks", "mean_score", "stored_chunk_count")


# 7. nearest chunks
def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest other chunks of every chunk with a usable vector."""
    return nearest_neighbours(_vectors(spark, folder, "p7")).withColumnRenamed("id", "chunk_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with a cosine of at least 0.975 that are among each other's three nearest."""
    pairs = mutual_pairs(nearest_neighbours(_vectors(spark, folder, "p7")), 0.975)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


# 8. leaked evaluation passages
def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items they leak, with how much of the item and where."""
    return find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items that share 13 consecutive words."""
    return p8_leaks(spark, folder).select("doc_id", "item_id")


# 9. mixing sources
def _sized(spark: SparkSession, folder: str) -> DataFrame:
    sized = count_tokens(table(spark, folder, "documents", "doc_id", "source", "text"), ("doc_id", "source"))
    one = sized.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.*")
    return Cuts(spark, "p9").cut(one)


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that the mix exhausts: each text is used as often as allowed, and the share is still missed."""
    return _mixed(spark, folder)[1].where("exhausted").select("source")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document used, with its number of copies."""
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the sources that the mix really reaches, and those that the caps leave possible."""
    return _mixed(spark, folder)[1]


def p9_kept_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source of the mix keeps the rules: no text too often, and what is used within one text of what is given."""
    sized = _sized(spark, folder)
    used, shares = mix(sized, table(spark, folder, "mix_targets"))
    most = table(spark, folder, "mix_targets", "source", "max_repeats").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    longest = sized.groupBy("source").agg(F.max("tokens").alias("longest"))
    per = used.groupBy("source").agg(F.max("copies").alias("copies"), (F.max("copies") - F.min("copies")).alias("spread"))
    near = F.abs(F.col("tokens_used") - F.col("given")) <= F.coalesce("longest", F.lit(0)) + 1
    return (
        shares.join(most, "source")
        .join(longest, "source", "left")
        .join(per, "source", "left")
        .select("source", (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), (F.coalesce("spread", F.lit(0)) <= 1).alias("copies_even"), near.alias("size_kept"))
    )


# 10. sentences
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets of the sentences of all notes."""
    notes = table(spark, folder, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'note'")
    return split_sentences(notes).select("doc_id", "start_char", "end_char")


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document, in order."""
    return split_sentences(table(spark, folder, "documents", "doc_id", "text"), with_text=True)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p2_rates, p3_found, p3_origins, p3_shared_packages, p5_found, p5_pieces, p5_kept_rules, p6_found, p6_clusters,
        p7_found, p7_neighbours, p8_found, p8_leaks, p9_found, p9_mix, p9_shares, p9_kept_rules, p10_found, p10_sentences,
    )
}
