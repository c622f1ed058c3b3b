"""Nearest vectors, centroids, drift, outliers and hashing of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_to
from ..session import Cuts, few_or_raise, map_frames, ship
from .graph import connected_components

#: Query vectors per block, and rows of the base per block, in blockwise searches.
QUERY_BLOCK = 2048
BASE_BLOCK = 8192


def nearest_to(df: DataFrame, query: list[float], k: int, id_col: str, vec: str) -> DataFrame:
    """The ``k`` rows most similar to a vector: ``id, score``; ties go to the smaller id."""
    return df.select(F.col(id_col), cosine_to(vec, query).alias("score")).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def _matrix(vs) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def nearest_to_each(queries: DataFrame, base: DataFrame, k: int | None, id_col: str = "id", vec: str = "vec", group: str | None = None, exclude_same_group: bool = False, least: float | None = None) -> DataFrame:
    """For every query row the ``k`` most similar rows of ``base``: ``q, c, cosine, rank``.

    Exact, in blocks of the base by blocks of the queries, so the work is their product but no task
    holds more than a block of each; use it for a stated query set.  A row is never its own neighbour; with
    ``exclude_same_group`` neither are rows of its group.  Null and zero vectors are left out, ties
    go to the smaller id.  The top-k is taken before any threshold a caller may add; with ``least`` only
    rows that reach the cosine come out (of the top-k, or with a ``k`` of None all, unranked).
    """
    if k is None and least is None:
        raise ValueError("either k or least is needed")
    ship(base.sparkSession)
    ok = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0))
    base, queries = ok(base), ok(queries)
    nb, nq = (max(1, -(-df.count() // BASE_BLOCK)) for df in (base, queries))
    g = [F.col(group).cast("string").alias("g")] if group else [F.lit(None).cast("string").alias("g")]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    b = base.select(F.col(id_col).alias("id"), F.col(vec).alias("v"), *g, F.lit(0).alias("side"), own(nb).alias("block"), each(nq).alias("qblock"))
    q = queries.select(F.col(id_col).alias("id"), F.col(vec).alias("v"), *g, F.lit(1).alias("side"), each(nb).alias("block"), own(nq).alias("qblock"))

    def _reaching(qs: pd.DataFrame, x: np.ndarray, bid: np.ndarray, bg: np.ndarray) -> pd.DataFrame:
        """The pairs of a block that reach ``least``: single precision with a margin finds them, double decides."""
        small, found = x.astype(np.float32), []
        margin = 1e-4 + 1e-6 * x.shape[1]
        for i in range(0, len(qs), QUERY_BLOCK):
            part = qs.iloc[i : i + QUERY_BLOCK]
            y, qid, qg = _matrix(part["v"]), part["id"].to_numpy(), part["g"].to_numpy()
            r, j = np.nonzero(y.astype(np.float32) @ small.T >= least - margin)
            other = qid[r] != bid[j]
            if exclude_same_group:
                other &= qg[r] != bg[j]
            r, j = r[other], j[other]
            s = np.concatenate([np.einsum("nd,nd->n", y[r[n : n + 65536]], x[j[n : n + 65536]]) for n in range(0, len(r), 65536)] or [np.zeros(0)])
            f = pd.DataFrame({"q": qid[r], "c": bid[j], "cosine": s})[s >= least]
            found.append(f if k is None else f.sort_values(["q", "cosine", "c"], ascending=[True, False, True]).groupby("q").head(k))
        return pd.concat(found)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        bs, qs = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out: list[tuple] = []
        if len(bs) and len(qs):
            x, bid, bg = _matrix(bs["v"]), bs["id"].to_numpy(), bs["g"].to_numpy()
            if least is not None:
                return _reaching(qs, x, bid, bg)
            for i in range(0, len(qs), QUERY_BLOCK):
                part = qs.iloc[i : i + QUERY_BLOCK]
                s = _matrix(part["v"]) @ x.T
                s[part["id"].to_numpy()[:, None] == bid[None, :]] = -np.inf
                if exclude_same_group:
                    s[part["g"].to_numpy()[:, None] == bg[None, :]] = -np.inf
                for r, qid in enumerate(part["id"]):
                    kk = min(k, s.shape[1])
                    # all rows as similar as the k-th, so that ties can be settled by id
                    edge = np.partition(s[r], s.shape[1] - kk)[s.shape[1] - kk]
                    top = np.nonzero(s[r] >= edge)[0]
                    top = top[np.lexsort((bid[top], -s[r][top]))][:kk]
                    out += [(qid, bid[j], s[r, j]) for j in top if np.isfinite(s[r, j])]
        return pd.DataFrame(out, columns=["q", "c", "cosine"])

    kind = base.schema[id_col].dataType.simpleString()
    found = b.unionByName(q).groupBy("block", "qblock").applyInPandas(meet, f"q {kind}, c {kind}, cosine double")
    if k is None:
        return found
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "c")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _joined(hit: np.ndarray) -> list[tuple[int, int, bool]]:
    """Per component of a matrix of links: (its first row, another row or column, whether that is a column)."""
    rows, cols = np.zeros(hit.shape[0], bool), np.zeros(hit.shape[1], bool)
    out: list[tuple[int, int, bool]] = []
    for root in np.nonzero(hit.any(1))[0]:
        if rows[root]:
            continue
        rows[root] = True
        front = np.array([root])
        while len(front):
            new = np.nonzero(hit[front].any(0) & ~cols)[0]
            cols[new] = True
            out += [(root, int(c), True) for c in new]
            front = np.nonzero(hit[:, new].any(1) & ~rows)[0]
            rows[front] = True
            out += [(root, int(r), False) for r in front]
    return out


def similarity_components(df: DataFrame, least: float, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``id, component`` (its smallest id) of the rows that chains of a cosine of at least ``least`` link to another.

    Exact over all rows, in blocks by blocks (each pair of blocks once), so the work grows with the
    square; two blocks give no more links than they have rows.  Null and zero vectors are left out.
    """
    ship(df.sparkSession)
    ok = Cuts(df.sparkSession, "similar").cut(df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(vec).alias("v")))
    blocks = max(1, -(-ok.count() // BASE_BLOCK))
    each = ok.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = (pdf[pdf["own"] == pdf[o].iloc[0]] for o in ("lo", "hi"))
        out: list[tuple] = []
        if len(p) and len(q):
            x, y, a, b = _matrix(p["v"]), _matrix(q["v"]), p["id"].to_numpy(), q["id"].to_numpy()
            hit = np.concatenate([x[i : i + QUERY_BLOCK] @ y.T >= least for i in range(0, len(x), QUERY_BLOCK)])
            out = [(a[r], b[n] if column else a[n]) for r, n, column in _joined(hit)]
        return pd.DataFrame([e for e in out if e[0] != e[1]], columns=["src", "dst"])

    kind = df.schema[id_col].dataType.simpleString()
    links = each.select("id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).groupBy("lo", "hi").applyInPandas(meet, f"src {kind}, dst {kind}")
    return connected_components(links.distinct(), "src", "dst")


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise mean vector per group: ``group, centroid, n``; null vectors are left out.

    Positions are averaged as rows and combined before the shuffle, so a large group is no single task.
    """
    p = df.where(F.col(vec).isNotNull()).select(group, F.posexplode(vec).alias("pos", "x"))
    m = p.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def local_outlier_factors(neighbours: DataFrame, k: int) -> DataFrame:
    """LOF from a table of neighbours ``q, c, cosine, rank``: ``id, lof``.

    Distance is 1 - cosine.  k-distance is the distance to the k-th neighbour, the reach distance of q
    from c the greater of their distance and c's k-distance, the density the inverse of the mean reach
    distance (at least 1e-12); LOF the mean density of the neighbours over the own.
    """
    n = neighbours.where(F.col("rank") <= k).select("q", "c", (1 - F.col("cosine")).alias("d"))
    kd = n.groupBy(F.col("q").alias("c")).agg(F.max("d").alias("kd"))
    lrd = n.join(kd, "c").groupBy("q").agg((1 / F.greatest(F.avg(F.greatest("d", "kd")), F.lit(1e-12))).alias("lrd"))
    return n.join(lrd.select(F.col("q").alias("c"), F.col("lrd").alias("lrd_c")), "c").join(lrd, "q").groupBy(F.col("q").alias("id")).agg((F.avg("lrd_c") / F.first("lrd")).alias("lof"))


def simhash_signatures(df: DataFrame, id_col: str, vec: str, bits: int = 64, seed: int = 42) -> DataFrame:
    """``id, signature``: one bit per seeded Gaussian hyperplane (1 on its non-negative side)."""
    first = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("n")).first()
    dim = first.n if first else 1
    planes = np.random.default_rng(seed).standard_normal((bits, dim))
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.uint64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                on = np.stack([np.asarray(v, np.float64) for v in b[vec]]) @ planes.T >= 0
                yield pd.DataFrame({id_col: b[id_col], "signature": (on * weights).sum(1, dtype=np.uint64).view(np.int64)})

    kind = df.schema[id_col].dataType.simpleString()
    return map_frames(df.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).select(id_col, vec), sign, f"{id_col} {kind}, signature long")


def simhash_pairs(signatures: DataFrame, id_col: str, bands: int = 4, bits: int = 64, most_distance: int | None = None) -> DataFrame:
    """Pairs within ``most_distance``, or that agree in a band: ``id_a, id_b, hamming, estimate`` (cosine from the angle).

    Rows with one signature are one class, so a band's key is shared by classes only.  With
    ``most_distance`` the pairs are complete: below ``bands`` by the pigeonhole principle, from there on
    because all classes are compared, in blocks (the work grows with their square).
    """
    width = bits // bands
    cls = signatures.groupBy("signature").agg(F.min(id_col).alias("rep"))
    if most_distance is not None and most_distance >= bands:
        pairs = _signatures_within(cls.select("signature"), most_distance)
        return _of_classes(signatures, cls, pairs, id_col, bits)
    mask = (1 << width) - 1
    key = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("signature", b * width).bitwiseAND(F.lit(mask)).alias("key")) for b in range(bands)])).alias("k")
    k = cls.select("signature", key).select("signature", "k.band", "k.key")
    pairs = k.join(k.select(F.col("signature").alias("s2"), "band", "key"), ["band", "key"]).where("signature < s2").select("signature", "s2").distinct()
    pairs = pairs.withColumn("hamming", F.bit_count(F.col("signature").bitwiseXOR(F.col("s2"))))
    if most_distance is not None:
        pairs = pairs.where(F.col("hamming") <= most_distance)
    return _of_classes(signatures, cls, pairs, id_col, bits)


def _signatures_within(classes: DataFrame, most: int) -> DataFrame:
    """``signature, s2, hamming`` of all pairs (smaller first) of distinct signatures at most ``most`` bits apart."""
    ship(classes.sparkSession)
    classes = Cuts(classes.sparkSession, "signatures").cut(classes.where("signature is not null"))
    blocks = max(1, -(-classes.count() // BASE_BLOCK))
    own = F.pmod(F.xxhash64("signature"), F.lit(blocks)).cast("int")
    each = classes.select("signature", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        x, y = (pdf.loc[pdf["own"] == o, "signature"].to_numpy() for o in (lo, hi))
        out = []
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            n = np.bitwise_count(part.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :])
            r, c = np.nonzero(n <= most)
            a, b, n = part[r], y[c], n[r, c]
            keep = a < b if lo == hi else a != b
            out.append(pd.DataFrame({"signature": np.minimum(a, b)[keep], "s2": np.maximum(a, b)[keep], "hamming": n[keep].astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"signature": [], "s2": [], "hamming": []})

    return each.select("signature", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).groupBy("lo", "hi").applyInPandas(meet, "signature long, s2 long, hamming int")


def _of_classes(signatures: DataFrame, cls: DataFrame, pairs: DataFrame, id_col: str, bits: int) -> DataFrame:
    """The pairs of rows behind pairs of signatures, and those within a signature."""
    pairs = pairs.unionByName(cls.select("signature", F.col("signature").alias("s2"), F.lit(0).alias("hamming")))
    a = signatures.select("signature", F.col(id_col).alias("a"))
    b = signatures.select(F.col("signature").alias("s2"), F.col(id_col).alias("b"))
    j = pairs.join(a, "signature").join(b, "s2").where("a <> b AND (hamming > 0 OR a < b)")
    return j.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "hamming", F.cos(F.col("hamming") * np.pi / bits).alias("estimate"))


def diverse_top(candidates: list[tuple], k: int, trade: float = 0.7) -> list[tuple]:
    """Maximal marginal relevance over a few hundred (id, score, vector): (id, value) in order of choice.

    Scores are scaled to 0..1; each step takes the greatest ``trade * score - (1 - trade) * greatest
    cosine to those chosen``; ties go to the earlier candidate.
    """
    if not candidates:
        return []
    s = np.array([c[1] for c in candidates], float)
    rel = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
    x = _matrix([c[2] for c in candidates])
    near = np.zeros(len(s))
    left, out = list(range(len(s))), []
    while left and len(out) < k:
        val = trade * rel[left] - (1 - trade) * near[left]
        i = left[int(np.argmax(val))]
        out.append((candidates[i][0], float(val.max())))
        left.remove(i)
        near = np.maximum(near, x @ x[i]) if out else near
    return out


def mmr(df: DataFrame, query: list[float], k: int, id_col: str, vec: str, pool: int = 200, trade: float = 0.7) -> DataFrame:
    """Diverse nearest rows: the ``pool`` most similar, reordered by :func:`diverse_top`; ``id, value, rank``."""
    top = df.select(F.col(id_col).alias("id"), cosine_to(vec, query).alias("score"), vec).where("score is not null").orderBy(F.desc("score"), "id").limit(pool)
    rows = few_or_raise(top, pool, "candidates")
    chosen = diverse_top([(r["id"], r["score"], r[vec]) for r in sorted(rows, key=lambda r: (-r["score"], r["id"]))], k, trade)
    return df.sparkSession.createDataFrame([(i, v, n + 1) for n, (i, v) in enumerate(chosen)], f"id {df.schema[id_col].dataType.simpleString()}, value double, rank int")
