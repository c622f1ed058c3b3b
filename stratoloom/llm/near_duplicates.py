"""Records that are largely the same in spite of edits: multi-index hashing over fingerprints.

A record is the set of its runs of ``k`` words.  Its fingerprint has one MinHash symbol per place:
two records agree in a place with the probability of their Jaccard similarity, so the Hamming
distance of the fingerprints (over symbols) estimates it.  The fingerprint is cut into segments,
each with a table of its own.  The Hamming ball of radius 1 around a segment is enumerated by
leaving out each symbol in turn: two segments lie within distance 1 of each other exactly if they
agree in one of these keys.  By the pigeonhole principle every pair with a distance below twice
the number of segments meets in a table; matches are verified by the complete distance and then
by the exact similarity of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts, map_frames

#: Runs of these characters of the lower-cased text are words.
CODE_WORD = r"[a-z0-9_]+"


def _shingle_hashes(text: str, word: str, k: int) -> F.Column:
    """Distinct hashes of the runs of ``k`` words of a text column, sorted; null for fewer words.

    Every word is hashed once, a run from the hashes of its words; both are bound to variables, or
    the planner would find the words anew for every run.
    """
    pattern = word.replace("\\", "\\\\").replace("'", "\\'")
    run = ", ".join(f"get(h, i + {j})" for j in range(k))
    return F.expr(
        f"transform(array(transform(regexp_extract_all(lower({text}), '{pattern}', 0), x -> xxhash64(x))), "
        f"h -> if(size(h) >= {k}, array_sort(array_distinct(transform(sequence(0, size(h) - {k}), i -> xxhash64({run})))), null))[0]"
    )


def _mix(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A keyed 64-bit mixer: one hash of every x for every seed."""
    with np.errstate(over="ignore"):
        z = x[None, :] ^ seed[:, None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _balls(fp: np.ndarray, segments: int, width: int) -> np.ndarray:
    """The cells of every fingerprint: for each segment and each place in it the hash of the other symbols."""
    parts = fp.reshape(len(fp), segments, width).view(np.uint32).astype(np.uint64)
    out = np.empty((len(fp), segments, width), dtype=np.uint64)
    for p in range(width):
        acc = np.broadcast_to(np.arange(segments, dtype=np.uint64) * np.uint64(width) + np.uint64(p), (len(fp), segments))
        for q in range(width):
            if q != p:
                acc = _mix((acc ^ (parts[:, :, q] << np.uint64(20))).ravel(), np.array([q + 1], dtype=np.uint64))[0].reshape(len(fp), segments)
        out[:, :, p] = acc
    return out.reshape(len(fp), segments * width).view(np.int64)


def fingerprints(sets: DataFrame, key: str, shingles: str, segments: int, width: int, seed: int = 7) -> DataFrame:
    """``key``, ``fp``, the fingerprint of ``segments * width`` symbols of 31 bits, and ``ball``, its cells in the tables.

    A cell stands for a segment, a place in it, and the symbols of its other places.
    """
    n = segments * width
    seeds = np.random.default_rng(seed).integers(1, 1 << 63, size=n, dtype=np.uint64)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s in b[shingles]:
                x = np.asarray(s, dtype=np.int64).view(np.uint64)
                best = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
                for i in range(0, len(x), 4096):
                    best = np.minimum(best, _mix(x[i : i + 4096], seeds).min(axis=1))
                out.append((best >> np.uint64(33)).astype(np.int32))
            fp = np.stack(out) if out else np.zeros((0, n), np.int32)
            yield pd.DataFrame({key: b[key], "fp": list(fp), "ball": list(_balls(fp, segments, width))})

    kind = sets.schema[key].dataType.simpleString()
    return map_frames(sets.select(key, shingles), sketch, f"{key} {kind}, fp array<int>, ball array<bigint>")


def near_duplicates(
    records: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, word: str = r"[\p{L}\p{N}_]+", segments: int = 32, width: int = 4, slack: float = 0.25
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal records, and all pairs of different classes that are near duplicates.

    Returns ``(members, pairs)``: ``members`` has ``key, class_id`` for every record whose text has
    at least ``k`` words; records with the same set of shingles share a class, whose id is its
    smallest key.  ``pairs`` has ``class_a, class_b`` (a < b) ``, similarity`` for every two classes
    whose sets share at least ``threshold`` of their union.  Null, empty and shorter texts have no
    set and are in no class; of rows with one key the greatest text counts; null keys are dropped.

    Pairs with a fingerprint distance under ``2 * segments`` places cannot be missed; a pair with
    similarity s beyond that is missed with probability (1 - s^w - w s^(w-1) (1-s))^segments, for the
    default sizes 6e-6 at s = 0.5 and 1e-24 at 0.8.  No table or bucket is capped: within a table
    classes are joined by key, hot keys are split by AQE, and copies count once.
    """
    cuts = Cuts(records.sparkSession, "neardup")
    rows = (
        records.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(text).alias("_text"))
        .select("_key", _shingle_hashes("_text", word, k).alias("sh"))
    )
    rows = cuts.cut(rows)
    rows = rows.where("sh is not null").withColumn("set_id", F.xxhash64("sh"))
    # equal sets become one class; the sets themselves are compared again when pairs are verified
    members = cuts.cut(rows.join(rows.groupBy("set_id").agg(F.min("_key").alias("class_id")), "set_id").select("_key", "class_id"))
    reps = rows.join(members.where("_key = class_id").select(F.col("_key")), "_key").select(F.col("_key").alias("class_id"), "sh")
    reps = cuts.cut(reps.join(fingerprints(reps, "class_id", "sh", segments, width), "class_id"))

    # the ball of radius 1 around every segment: the segment with one symbol left out, for each place
    keys = reps.select("class_id", F.explode("ball").alias("cell"))
    # cells with a single class have no match; the count is combined before the shuffle
    full = keys.groupBy("cell").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi").select("cell")
    keys = cuts.cut(keys.join(full, "cell"))
    a, b = keys.select("cell", F.col("class_id").alias("class_a")), keys.select("cell", F.col("class_id").alias("class_b"))
    candidates = cuts.cut(a.join(b, "cell").where("class_a < class_b").select("class_a", "class_b").distinct())
    # the complete distance first, from the small fingerprints; then the exact sets
    most = int(segments * width * (1 - threshold + slack))
    fa = reps.select(F.col("class_id").alias("class_a"), F.col("fp").alias("fp_a"))
    fb = reps.select(F.col("class_id").alias("class_b"), F.col("fp").alias("fp_b"))
    distance = F.expr("aggregate(zip_with(fp_a, fp_b, (x, y) -> if(x = y, 0, 1)), 0, (s, x) -> s + x)")
    near = cuts.cut(candidates.join(fa, "class_a").join(fb, "class_b").where(distance <= most).select("class_a", "class_b"))
    sa = reps.select(F.col("class_id").alias("class_a"), F.col("sh").alias("sh_a"))
    sb = reps.select(F.col("class_id").alias("class_b"), F.col("sh").alias("sh_b"))
    common = F.size(F.array_intersect("sh_a", "sh_b"))
    similarity = common / (F.size("sh_a") + F.size("sh_b") - common)
    pairs = near.join(sa, "class_a").join(sb, "class_b").select("class_a", "class_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return members.withColumnRenamed("_key", key), cuts.cut(pairs)


def expand_pairs(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """All pairs of different records: ``key_a, key_b`` (a < b) ``, similarity``; copies have 1."""
    a, b = members.select(F.col("class_id").alias("class_a"), F.col(key).alias("ka")), members.select(F.col("class_id").alias("class_b"), F.col(key).alias("kb"))
    across = pairs.join(a, "class_a").join(b, "class_b").select("ka", "kb", "similarity")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("ka < kb").select("ka", "kb", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"), "similarity")


def duplicate_groups(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Every record with its group: ``key, class_id, group_id, links``.

    Groups are the connected components of classes over the pairs; ``group_id`` is the smallest
    class id, ``links`` the number of near-duplicate classes of the record's class (copies are not
    counted as links).
    """
    from ..operators.graph import connected_components

    links = pairs.select(F.col("class_a").alias("c")).unionByName(pairs.select(F.col("class_b").alias("c"))).groupBy("c").agg(F.count("*").alias("links"))
    comp = connected_components(pairs.select(F.col("class_a").alias("src"), F.col("class_b").alias("dst")))
    return (
        members.join(comp.select(F.col("id").alias("class_id"), F.col("component").alias("g")), "class_id", "left")
        .join(links.withColumnRenamed("c", "class_id"), "class_id", "left")
        .select(key, "class_id", F.coalesce("g", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
