"""Evaluation passages that appear in a training corpus: a prefix-filtered set join.

An item is cut into windows of ``window`` words; a document leaks the item if it holds one of
them word for word.  Each window is a set of shingles of ``shingle`` words that must all be
there, so one necessary prefix token is enough: the shingle that is rarest in the corpus.  Only
document positions that hold such a token become candidates; the length and positional bounds
drop those where the window would stick out of the text; the rest is verified exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts, broadcast_if_small

#: Runs of letters and digits; all else parts words.
WORD = r"[\p{L}\p{Nd}]+"


def words(text) -> F.Column:
    """The words of the lower-cased text in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


#: The same in SQL, of a column ``_text``.
_WORDS = "coalesce(regexp_extract_all(lower(_text), '" + WORD.replace("\\", "\\\\") + "', 0), cast(array() as array<string>))"


def _shingles(w: str, k: int, least: int) -> str:
    """SQL for the hashes of all runs of ``k`` words of an array, in order; none for fewer than ``least`` words.

    Every word is hashed once, a run from the hashes of its words (a hash may err; candidates are
    verified).  Arrays are bound to variables, or the planner would find them anew for every use.
    """
    run = ", ".join(f"get(h, i + {j})" for j in range(k))
    return f"if(size({w}) >= {least}, transform(array(transform({w}, x -> xxhash64(x))), h -> transform(sequence(0, size(h) - {k}), i -> xxhash64({run})))[0], cast(array() as array<bigint>))"


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 13, shingle: int = 5) -> DataFrame:
    """One row per document and item that share ``window`` consecutive words.

    Returns ``doc_id, item_id, windows`` (how many different windows of the item the document
    holds), ``item_windows`` and ``first_word`` (the first place in the document, from 0).
    Texts shorter than the window, empty or null share nothing.  Rows that repeat an id and text
    count once; a passage that occurs several times counts once per item window.

    The corpus is read in full and without moving it: once to count the items' shingles over all
    documents, once to find the places of prefix tokens, once for the words of the documents that
    have such places; only counts, places and the words of these documents are shuffled.
    The item side is broadcast if its measured size allows, else joined by shuffle.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "leaks")
    it = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("iw")).distinct()
    wins = it.where(F.size("iw") >= window).select(
        "item_id",
        F.size("iw").alias("n_words"),
        F.posexplode(F.expr(f"transform(sequence(1, size(iw) - {window - 1}), i -> slice(iw, i, {window}))")).alias("at", "win"),
    )
    # the same window in several items or places is matched once
    wins = wins.withColumn("wid", F.xxhash64("win"))
    passages = cuts.cut(wins.groupBy("wid", "win").agg(F.count("*").alias("uses")).withColumn("sh", F.expr(_shingles("win", shingle, shingle))))
    owners = cuts.cut(wins.select("item_id", "at", "win").distinct())
    per_item = owners.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    tokens = passages.select(F.posexplode("sh").alias("off", "token"), "wid", "win")

    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    # words are found once a pass; places carry no text, as it would be copied for each of them
    found = d.select("doc_id", F.expr(f"transform(array({_WORDS}), w -> named_struct('n', size(w), 'sh', {_shingles('w', shingle, window)}))[0]").alias("p"))
    # (the outer form, or the planner would find the shingles once more to drop texts without any)
    places = found.select("doc_id", "p.n", F.posexplode_outer("p.sh").alias("pos", "token")).where("token is not null")

    vocabulary = broadcast_if_small(tokens.select("token").distinct())
    # counts over all documents, combined before the shuffle
    counts = places.select("token").join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("df"))
    order = tokens.join(counts, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # a window whose rarest shingle occurs nowhere cannot occur
    prefix = order.groupBy("wid", "win").agg(F.min(F.struct("df", "off", "token")).alias("p")).where("p.df > 0").select("wid", "win", F.col("p.token").alias("token"), F.col("p.off").alias("off"))
    prefix = cuts.cut(prefix)
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + window <= F.col("n"))
    at = cuts.cut(places.join(broadcast_if_small(prefix.select("wid", "token", "off")), "token").where(fits).select("doc_id", "wid", start.alias("start")).distinct())
    # only the words of documents with such places are found again, each text verified for itself
    some = d.join(broadcast_if_small(at.select("doc_id").distinct()), "doc_id", "left_semi")
    matched = some.select("doc_id", words(F.col("_text")).alias("dw")).join(broadcast_if_small(at), "doc_id").join(broadcast_if_small(prefix.select("wid", "win")), "wid")
    hits = matched.where(F.slice("dw", F.col("start") + 1, window) == F.col("win")).groupBy("doc_id", "win").agg(F.min("start").alias("first_word"))
    return (
        hits.join(broadcast_if_small(owners), "win")
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("win").alias("windows"), F.min("first_word").alias("first_word"))
        .join(broadcast_if_small(per_item), "item_id")
        .select("doc_id", "item_id", "windows", "item_windows", "first_word")
    )
