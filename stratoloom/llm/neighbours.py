"""The most similar vectors of every vector, by a forest of random-projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts, few_or_raise, map_frames, ship
from .forest import Forest, fit_forest

#: The forest is fitted on about this many vectors, or on as many as its leaves need, up to the second number; all vectors are indexed.
SAMPLE_ROWS = 32_768
MOST_SAMPLE_ROWS = 262_144
#: A leaf's place and size follow from at least so many rows of the sample.
SAMPLE_PER_LEAF = 16
_BLOCK_ROWS = 4096
#: About so much of the routed vectors is read by one task.
TASK_BYTES = 16 << 20


def usable_vectors(rows: DataFrame, key: str, vector: str, dim: int = 64) -> DataFrame:
    """``id, vec``: one row for each key with a vector of ``dim`` numbers, no NaN, not all zero.

    Vectors with null or infinite numbers are not usable either.  Of rows with one key the greatest
    vector counts; null keys are dropped.
    """
    v = F.col(vector)
    ok = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(key).isNotNull() & v.isNotNull() & F.coalesce(ok, F.lit(False))).groupBy(F.col(key).alias("id")).agg(F.max(v.cast("array<float>")).alias("vec"))


def unit_matrix(vectors) -> np.ndarray:
    """The vectors as unit rows of doubles."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def vector_sample(vectors: DataFrame, most: int, n: int) -> np.ndarray:
    """About ``most`` of the ``n`` unit vectors, chosen by a hash of the id (all, if there are fewer).

    They reach the driver as bytes of single precision.
    """
    if n > most:
        vectors = vectors.where(F.expr(f"pmod(xxhash64(id, 11), {n}) < {most}"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": [v.tobytes() for v in unit_matrix(b["vec"]).astype(np.float32)]})

    kind = vectors.schema["id"].dataType.simpleString()
    rows = few_or_raise(map_frames(vectors.select("id", "vec"), pack, f"id {kind}, v binary"), 2 * most + 1000, "vector sample")
    rows.sort(key=lambda r: r.id)
    return np.frombuffer(b"".join(r.v for r in rows), dtype=np.float32).reshape(len(rows), -1).copy() if rows else np.zeros((0, 1), np.float32)


def _route(forest: Forest, blocks: np.ndarray, visits: int):
    """A function that sends every vector to the leaves it is indexed in (role 0), searches (1), or both (2)."""
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = unit_matrix(b["vec"])
            home = forest.homes(x.astype(np.float32))
            rows = np.arange(len(x))
            other_row, other_leaf = np.repeat(rows, min(visits, forest.trees * forest.leaves)), forest.opened(x.astype(np.float32), visits).ravel()
            away_from_home = (other_leaf[:, None] != home[other_row]).all(axis=1)
            other_row, other_leaf = other_row[away_from_home], other_leaf[away_from_home]
            ids = b["id"].to_numpy()
            # a leaf of many rows is searched in blocks of its rows by blocks of its queries; a vector is in
            # one block of either kind, the same, in the leaves it is indexed in
            home_row, home_leaf = np.repeat(rows, forest.trees), home.ravel()

            def spread(row, leaf):
                times = blocks[leaf]
                each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                return np.repeat(row, times), np.repeat(leaf, times), each, np.repeat(ids[row] % times, times)

            ask = [np.concatenate(z) for z in zip(spread(home_row, home_leaf), spread(other_row, other_leaf))]
            index_only = spread(home_row, home_leaf)
            away = index_only[2] != index_only[3]
            at_home = np.concatenate([np.ones(blocks[home_leaf].sum(), bool), np.zeros(len(ask[0]) - blocks[home_leaf].sum(), bool)])
            row = np.concatenate([ask[0], index_only[0][away]])
            leaf = np.concatenate([ask[1], index_only[1][away]])
            block = np.concatenate([ask[2], index_only[3][away]])
            qblock = np.concatenate([ask[3], index_only[2][away]])
            role = np.concatenate([np.where(at_home & (ask[2] == ask[3]), 2, 1), np.zeros(away.sum(), int)])
            raw = [v.tobytes() for v in x.astype(np.float32)]
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "block": block.astype(np.int32), "qblock": qblock.astype(np.int32), "role": role.astype(np.int8), "id": ids[row], "v": [raw[r] for r in row]})

    return route


def _leaf_neighbours(k: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["v"]), dtype=np.float32).reshape(len(pdf), -1)
        ids, role = pdf["id"].to_numpy(), pdf["role"].to_numpy()
        inside = np.nonzero(role != 1)[0]
        base, base_ids = x[inside], ids[inside]
        x, ids = x[role != 0], ids[role != 0]
        out_q, out_c, out_s = [], [], []
        if len(inside):
            kk = min(k + 1, len(inside))
            for i in range(0, len(x), 512):
                s = x[i : i + 512] @ base.T
                s[ids[i : i + 512, None] == base_ids[None, :]] = -2.0
                top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
                # the scores of those kept, in double precision
                q = x[i : i + 512].astype(np.float64)
                c = base[top].astype(np.float64)
                sc = np.einsum("rd,rkd->rk", q, c)
                sc /= np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=2)
                keep = np.take_along_axis(s, top, 1) > -1.5
                out_q.append(np.repeat(ids[i : i + 512], kk)[keep.ravel()])
                out_c.append(base_ids[top].ravel()[keep.ravel()])
                out_s.append(sc.ravel()[keep.ravel()])
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        return pd.DataFrame({"q": cat(out_q, np.int64), "c": cat(out_c, np.int64), "cosine": cat(out_s, np.float64)})

    return search


def nearest_neighbours(vectors: DataFrame, k: int = 3, trees: int = 4, leaf_rows: int = 2048, visits: int = 12, sample_rows: int = SAMPLE_ROWS, seed: int = 3, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """The ``k`` most similar other vectors of every vector: ``id, neighbour, cosine, rank``.

    ``vectors`` is the result of :func:`usable_vectors`.  Rank 1 is the most similar, ties go to the
    smaller id.  Vectors that are equal number by number are searched once and expanded after, so a
    third of all rows may be copies of one vector; each then has its first copies as neighbours.
    A table of one vector gives no rows.

    The depth of the trees follows the number of rows, so that leaves keep about ``leaf_rows``, and so
    does the sample on which they are fitted, from ``sample_rows`` up to ``MOST_SAMPLE_ROWS``; every vector is indexed in one leaf of each
    tree and searched in ``visits`` leaves, those the priority queue over all trees opens first.
    Leaves that grow beyond ``block_rows`` are searched in blocks of rows by blocks of queries.  The result is approximate:
    measured recall stands in the README.
    """
    spark = vectors.sparkSession
    cuts = Cuts(spark, "neighbours")
    keyed = vectors.withColumn("h", F.xxhash64("vec"))
    first = keyed.groupBy("h", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    base = cuts.cut(first.select("id", "vec", "copies", "h"))
    n = base.count()
    depth = max(0, min(math.ceil(math.log2(max(1, n) / leaf_rows)), int(math.log2(max(sample_rows, MOST_SAMPLE_ROWS) // SAMPLE_PER_LEAF))))
    sample = vector_sample(base, max(sample_rows, SAMPLE_PER_LEAF << depth), n)
    forest = fit_forest(sample, trees, depth, seed, tries=24)
    # how many blocks a leaf has follows from its share of the sample
    blocks = np.maximum(1, np.ceil(forest.leaf_share.reshape(-1) * n / block_rows)).astype(int)
    routed = map_frames(base.select("id", "vec"), _route(forest, blocks, visits), "leaf int, block int, qblock int, role byte, id long, v binary")
    ship(spark)
    # a task's share of what is routed stays the same, however many rows there are
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * (visits + trees) * (4 * len(sample[0]) + 32) / TASK_BYTES) if n else 1)
    found = routed.repartition(tasks, "leaf", "block", "qblock").groupBy("leaf", "block", "qblock").applyInPandas(_leaf_neighbours(k), "q long, c long, cosine double")
    # at most visits * (k + 1) rows a vector come together here (times the blocks of a leaf)
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("s"), "c"))), 1, k)
    reps = cuts.cut(found.groupBy("q").agg(best.alias("best")).select("q", F.posexplode("best").alias("pos", "b")).select("q", F.col("b.c").alias("c"), (-F.col("b.s")).alias("cosine"), (F.col("pos") + 1).alias("rank")))

    copied = base.where("copies > 1").select("h", "vec", F.col("id").alias("rep"))
    # the first k + 1 copies of a vector are enough to fill anyone's list
    copies = keyed.join(copied, ["h", "vec"]).select("rep", "id")
    some = cuts.cut(copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("member")))
    targets = reps.join(some, reps.c == some.rep, "left").select("q", F.coalesce("member", "c").alias("c"), "cosine")
    same = copies.select(F.col("rep").alias("r"), F.col("id").alias("q")).join(some, F.col("r") == F.col("rep")).where("q <> member").select("q", F.col("member").alias("c"), F.lit(1.0).alias("cosine"))
    others = copies.select(F.col("rep").alias("q0"), F.col("id").alias("q1")).join(targets, F.col("q0") == F.col("q")).select(F.col("q1").alias("q"), "c", "cosine")
    alone = targets.join(some.select(F.col("rep").alias("x")).distinct(), F.col("q") == F.col("x"), "left_anti")
    top = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("s"), "c"))), 1, k)
    return (
        alone.unionByName(others)
        .unionByName(same)
        .groupBy("q")
        .agg(top.alias("best"))
        .select("q", F.posexplode("best").alias("pos", "b"))
        .select(F.col("q").alias("id"), F.col("b.c").alias("neighbour"), (-F.col("b.s")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
    )


def mutual_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """Pairs with at least this cosine that are among each other's neighbours: ``id_a, id_b, cosine`` (a < b)."""
    near = neighbours.where(F.col("cosine") >= least).select("id", "neighbour", "cosine")
    both = near.groupBy(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).agg(F.countDistinct("id").alias("n"), F.max("cosine").alias("cosine"))
    return both.where("n = 2").select("id_a", "id_b", "cosine")
