"""Trees over vectors: summaries from leaves to a root, merge orders of topics, clusters that follow a stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts, few_or_raise, ship
from .learning import _memberships, _stack, kmeans_pp
from .vectors import centroids, nearest_to

#: A node is split by centres fitted on about so many of its rows; all rows are assigned.
NODE_SAMPLE = 512


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit length by k-means on directions."""
    c = kmeans_pp(x, k)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def summary_tree(vectors: DataFrame, id_col: str = "id", vec: str = "vec", fanout: int = 8, leaf_rows: int = 32) -> tuple[DataFrame, DataFrame]:
    """``(nodes, leaves)``: ``node, parent, level, size, vec`` from the root (level 0) down, and ``id, node`` of every row.

    From the top down every node of more than ``leaf_rows`` rows is split into at most ``fanout``
    children by the centres of a bounded sample of its rows; a node's vector is the mean of the unit
    vectors of all rows below it, which stands for them as their summary.  The rounds grow with the
    logarithm of the number of rows, a round moves every row of an open node once, in blocks of a
    node, so that no task holds a whole node.  A node whose rows are equal stays a leaf.  Null ids and
    vectors are dropped, of rows with one id one counts; names of nodes are paths such as ``r.3.0``.
    """
    spark = vectors.sparkSession
    cuts = Cuts(spark, "summary-tree")
    kind = vectors.schema[id_col].dataType.simpleString()
    length = "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(vec).cast("array<double>")).alias("v"))
    rows = cuts.cut(rows.select("id", F.lit("r").alias("node"), F.expr(f"transform(v, x -> x / greatest({length}, 1e-12D))").alias("v")))
    ship(spark)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _stack(pdf.sort_values("id")["v"])
        c = _centres(x, fanout) if len(np.unique(x, axis=0)) > 1 else x[:0]
        return pd.DataFrame({"node": [pdf["node"].iloc[0]] * len(c), "child": np.arange(len(c), dtype=np.int32), "c": list(c)})

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        own, model = pdf[pdf["child"] < 0], pdf[pdf["child"] >= 0]
        if not len(own):
            return pd.DataFrame({"id": [], "node": [], "v": []})
        near = model["child"].to_numpy()[(_stack(own["v"]) @ _stack(model["v"]).T).argmax(1)]
        return pd.DataFrame({"id": own["id"], "node": [f"{n}.{j}" for n, j in zip(own["node"], near)], "v": own["v"]})

    placed, open_, parts = None, rows, []
    while True:
        sizes = cuts.cut(open_.groupBy("node").agg(F.count(F.lit(1)).alias("size")))
        mean = centroids(open_.select("node", F.col("v").alias("vec")), "node", "vec")
        parts.append(cuts.cut(sizes.join(mean.select("node", F.col("centroid").alias("vec")), "node")))
        large = sizes.where(F.col("size") > leaf_rows)
        sample = open_.join(large, "node").where(F.expr(f"pmod(xxhash64(id, node), size) < {NODE_SAMPLE}"))
        models = cuts.cut(sample.groupBy("node").applyInPandas(fit, "node string, child int, c array<double>"))
        split = cuts.cut(models.select("node").distinct().join(sizes, "node").select("node", F.ceil(F.col("size") / 4096).cast("int").alias("nb")))
        done = open_.join(split, "node", "left_anti").select("id", "node")
        placed = cuts.cut(done) if placed is None else placed.unionByName(cuts.cut(done))
        if split.isEmpty():
            break
        own = open_.join(split, "node").select(F.col("id"), "node", "v", F.lit(-1).alias("child"), F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("b"))
        model = models.join(split, "node").select(F.lit(None).cast(kind).alias("id"), "node", F.col("c").alias("v"), "child", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
        open_ = cuts.cut(own.unionByName(model).groupBy("node", "b").applyInPandas(assign, f"id {kind}, node string, v array<double>"))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    level = F.size(F.split("node", r"\.")) - 1
    return nodes.select("node", F.when(F.col("node") != "r", F.regexp_replace("node", r"\.\d+$", "")).alias("parent"), level.alias("level"), "size", "vec"), placed


def summary_search(nodes: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` nodes of all levels that are most similar to a query, as the whole tree is searched at once."""
    return nearest_to(nodes.select("node", "vec"), query, k, "node", "vec")


def merge_order(topics: DataFrame, id_col: str = "id", vec: str = "vec", most: int = 4000) -> list[tuple]:
    """(step, a, b, distance, size): the topics merged two at a time by average cosine distance.

    A cluster goes by its smallest topic, ``a < b``; ties go to the smaller names.  Topics are few: more
    than ``most`` raise.  Null and zero vectors are left out.
    """
    rows = few_or_raise(topics.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).alias("i"), F.col(vec).alias("v")), most, "topics")
    rows = sorted((r for r in rows if any(r.v)), key=lambda r: r.i)
    if len(rows) < 2:
        return []
    x = _stack([r.v for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(len(rows), dtype=int), []
    for step in range(len(rows) - 1):
        a, b = divmod(int(np.round(d, 12).argmin()), len(rows))
        a, b = min(a, b), max(a, b)
        # the mean over all pairs of the merged clusters
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        out.append((step, rows[a].i, rows[b].i, float(d[a, b]), int(size[a] + size[b])))
        size[a] += size[b]
        d[a], d[:, a] = merged, merged
        d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
    return out


def cut_merges(ids: list, merges: list[tuple], distance: float) -> dict:
    """The cluster (its smallest topic) of each id after all merges up to a distance."""
    of = {i: i for i in ids}
    for _, a, b, d, _ in merges:
        if d <= distance:
            for i, c in of.items():
                if c == b:
                    of[i] = a
    return of


class OnlineClusters:
    """Fuzzy c-means that follows a stream: each batch moves the centres by its weighted means, old weight fades.

    ``update`` takes a DataFrame of new rows (``foreachBatch`` gives one per batch): sums are combined
    before they reach the driver, which holds the k centres and their weights only.
    """

    def __init__(self, centres: np.ndarray, m: float = 2.0, keep: float = 0.9):
        self.centres, self.weights = np.array(centres, dtype=float), np.zeros(len(centres))
        self.m, self.keep = m, keep

    def update(self, batch: DataFrame, vec: str = "vec") -> np.ndarray:
        from ..session import map_frames

        now, m = self.centres, self.m

        def sums(batches):
            acc = np.zeros((len(now), now.shape[1] + 1))
            for b in batches:
                if len(b):
                    x = _stack(b["v"])
                    u = _memberships(x, now, m) ** m
                    acc[:, 0] += u.sum(0)
                    acc[:, 1:] += u.T @ x
            yield pd.DataFrame({"pos": np.arange(acc.size), "val": acc.ravel()})

        total = map_frames(batch.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v")), sums, "pos int, val double").groupBy("pos").agg(F.sum("val").alias("val"))
        acc = np.zeros(now.shape[0] * (now.shape[1] + 1))
        for r in few_or_raise(total, len(acc), "sums"):
            acc[r.pos] = r.val
        acc = acc.reshape(now.shape[0], -1)
        old = self.keep * self.weights
        weight = old + acc[:, 0]
        moved = weight > 0
        self.centres = np.where(moved[:, None], (old[:, None] * now + acc[:, 1:]) / np.where(moved, weight, 1)[:, None], now)
        self.weights = weight
        return self.centres
