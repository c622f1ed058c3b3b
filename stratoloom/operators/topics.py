"""Analytics over topic assignments: who holds what, where topics meet, what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import bus_factor, concentration
from .text import entropy


def topic_histogram(assigned: DataFrame, group: str) -> DataFrame:
    """``group, topic_id, n, share`` from ``group, topic_id`` rows (one per chunk and topic)."""
    h = assigned.where(F.col(group).isNotNull() & F.col("topic_id").isNotNull()).groupBy(group, "topic_id").agg(F.count(F.lit(1)).alias("n"))
    t = h.groupBy(group).agg(F.sum("n").alias("_t"))
    return h.join(t, group).select(group, "topic_id", "n", (F.col("n") / F.col("_t")).alias("share"))


def topic_profile(histogram: DataFrame, group: str) -> DataFrame:
    """Per group its topics, entropy (nats), normalised entropy, HHI, Gini (0..1) and specialisation (1 - normalised)."""
    e = entropy(histogram, [group], "n")
    c = concentration(histogram, group, "n").select(group, "hhi", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "gini")).alias("gini"))
    return e.join(c, group).withColumn("specialisation", 1 - F.col("normalised"))


def co_occurrence(histogram: DataFrame, group: str) -> DataFrame:
    """Topic pairs by the groups that hold both: ``topic_a, topic_b, groups, weight`` (weight: the sum of the lesser counts)."""
    a = histogram.select(group, F.col("topic_id").alias("topic_a"), F.col("n").alias("na"))
    b = histogram.select(group, F.col("topic_id").alias("topic_b"), F.col("n").alias("nb"))
    return a.join(b, group).where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.least("na", "nb")).alias("weight"))


def group_similarity(histogram: DataFrame, group: str, least: float = 0.0) -> DataFrame:
    """Pairs of groups by the cosine of their topic counts: ``a, b, cosine`` (a < b, at least ``least``).

    Groups meet through the topics they share; a pair without a common topic does not come out.
    """
    norms = histogram.groupBy(group).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    a = histogram.select(F.col(group).alias("a"), "topic_id", F.col("n").alias("na"))
    b = histogram.select(F.col(group).alias("b"), "topic_id", F.col("n").alias("nb"))
    d = a.join(b, "topic_id").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    d = d.join(norms.select(F.col(group).alias("a"), F.col("norm").alias("x")), "a").join(norms.select(F.col(group).alias("b"), F.col("norm").alias("y")), "b")
    return d.select("a", "b", (F.col("dot") / (F.col("x") * F.col("y"))).alias("cosine")).where(F.col("cosine") >= least)


def coverage_gaps(chunks: DataFrame, assigned: DataFrame, thin: int = 5) -> DataFrame:
    """Where the topics are weak: ``kind, key, n``, orphan chunks per file and topics with fewer than ``thin`` chunks."""
    orphans = chunks.select("chunk_id", "file_id").distinct().join(assigned.select("chunk_id").distinct(), "chunk_id", "left_anti").groupBy(F.col("file_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphans").alias("kind"), F.col("key").cast("long").alias("key"), "n")
    few = assigned.groupBy(F.col("topic_id").cast("long").alias("key")).agg(F.countDistinct("chunk_id").alias("n")).where(F.col("n") < thin).select(F.lit("thin topic").alias("kind"), "key", "n")
    return orphans.unionByName(few)


def owners(lines: DataFrame, item: str, owner: str, amount: str, coverage: float = 0.5) -> DataFrame:
    """Ownership per item: bus factor by cumulative coverage and by whole shares, owners, top share."""
    shares = lines.groupBy(item, owner).agg(F.sum(amount).alias("_a"))
    return bus_factor(shares, item, owner, "_a", coverage)


def top_share_map(histogram: DataFrame, group: str) -> DataFrame:
    """Per topic the groups that hold it and the share of the largest: ``topic_id, groups, top_group, top_share``."""
    t = histogram.groupBy("topic_id").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("groups"), F.max_by(group, F.struct("n", (-F.col(group)).alias("g"))).alias("top_group"), F.max("n").alias("m"))
    return t.select("topic_id", "groups", "top_group", (F.col("m") / F.col("t")).alias("top_share"))


def npmi(words: DataFrame, labels: DataFrame) -> DataFrame:
    """Topic coherence: mean normalised pointwise mutual information of each label's word pairs over documents.

    ``words`` has ``doc, word``, ``labels`` has ``topic, word``.  A pair that never meets counts -1, one that always
    does 1.  Only label words are counted.
    """
    w = words.select("doc", "word").distinct()
    n = w.agg(F.countDistinct("doc").alias("n"))
    hit = w.join(labels.select("word").distinct(), "word", "left_semi")
    single = hit.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    pairs = labels.select("topic", F.col("word").alias("wa")).join(labels.select("topic", F.col("word").alias("wb")), "topic").where("wa < wb")
    need = pairs.select("wa", "wb").distinct()
    both = hit.select("doc", F.col("word").alias("wa")).join(need, "wa").join(hit.select("doc", F.col("word").alias("wb")), ["doc", "wb"]).groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("cab"))
    j = pairs.join(both, ["wa", "wb"], "left").join(single.select(F.col("word").alias("wa"), F.col("c").alias("ca")), "wa", "left").join(single.select(F.col("word").alias("wb"), F.col("c").alias("cb")), "wb", "left")
    # one row
    j = j.crossJoin(F.broadcast(n))
    p = F.col("cab") / F.col("n")
    value = F.when(F.col("cab").isNull(), -1.0).when(p >= 1, 1.0).otherwise(F.log(p / ((F.col("ca") / F.col("n")) * (F.col("cb") / F.col("n")))) / -F.log(p))
    return j.groupBy("topic").agg(F.avg(value).alias("npmi"), F.count(F.lit(1)).alias("pairs"))


def diversity(labels: DataFrame) -> DataFrame:
    """One row ``diversity``: different label words over all label words."""
    return labels.agg((F.countDistinct("word") / F.count(F.lit(1))).alias("diversity"))


def trend(weekly: DataFrame, key: str) -> DataFrame:
    """Running totals per key and week: ``key, week, added, total``."""
    w = Window.partitionBy(key).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return weekly.withColumn("total", F.sum("added").over(w))
