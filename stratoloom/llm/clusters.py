"""Clusters of mutually similar vectors: a Gaussian mixture, then exact chains of similar rows.

The mixture (expectation-maximisation, full covariances shrunk towards spheres, on standardised
and reduced features, number of components by the Bayesian information criterion) says where the
rows are dense, fitted on all of them; the members of highest density stand for their components and are the pivots from
which chains are followed.  Chains that no pivot sees are found by an exact check, pruned by the
Cauchy-Schwarz bound in the plane of two centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import Cuts, few_or_raise, map_frames
from .neighbours import unit_matrix

COMPONENTS = (8, 16, 32, 48, 64, 96)
_BLOCK_ROWS = 4096


@dataclass
class Mixture:
    """A Gaussian mixture over reduced features z = (x - mean) / scale @ basis."""

    mean: np.ndarray
    scale: np.ndarray
    basis: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    whiten: np.ndarray  # components x d x d, inverse Cholesky factors (upper, applied from the right)
    logdet: np.ndarray
    bic: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.basis

    def log_parts(self, z: np.ndarray) -> np.ndarray:
        """log weight + log density of every row under every component."""
        d = z.shape[1]
        out = np.empty((len(z), len(self.weights)))
        for k in range(len(self.weights)):
            y = (z - self.centres[k]) @ self.whiten[k]
            out[:, k] = np.log(self.weights[k] + 1e-300) - 0.5 * (np.einsum("nd,nd->n", y, y) + self.logdet[k] + d * np.log(2 * np.pi))
        return out


def _seeds(x: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` distant ones of the weighted rows (greedy k-means++: of some candidates the one that lowers the total distance most)."""
    rng = np.random.default_rng(seed)
    n = len(x)
    chosen = [int(rng.choice(n, p=weights / weights.sum()))]
    dist = ((x - x[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        mass = dist * weights
        cand = rng.choice(n, 4, p=mass / mass.sum()) if mass.sum() > 0 else rng.integers(n, size=4)
        ds = [np.minimum(dist, ((x - x[c]) ** 2).sum(1)) for c in cand]
        best = int(np.argmin([(d * weights).sum() for d in ds]))
        chosen.append(int(cand[best]))
        dist = ds[best]
    return x[chosen]


def _squared_distances(z: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((z**2).sum(1)[:, None] - 2 * z @ c.T + (c**2).sum(1), 0.0)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) that follows from the id (splitmix64)."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _monomials(z: np.ndarray) -> np.ndarray:
    """1, the features and their products: what the log densities and the sums of moments are linear in."""
    a, b = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, a] * z[:, b]], axis=1)


def _maximised(moments: np.ndarray, n: int, d: int, shrink: float, floor: float) -> tuple:
    """(weights, centres, whiten, logdet, nk) from every component's sums of :func:`_monomials`."""
    k = len(moments)
    nk = moments[:, 0] + 1e-9
    centres = moments[:, 1 : d + 1] / nk[:, None]
    whiten, logdet = np.empty((k, d, d)), np.empty(k)
    a, b = np.triu_indices(d)
    for j in range(k):
        s = np.empty((d, d))
        s[a, b] = s[b, a] = moments[j, d + 1 :]
        s = s / nk[j] - np.outer(centres[j], centres[j])
        sphere = max(np.trace(s) / d, floor)
        # the fewer rows a component has for its dimensions, the more it is a sphere
        lam = max(shrink, min(1.0, d / nk[j]))
        low = np.linalg.cholesky((1 - lam) * s + (lam * sphere + floor) * np.eye(d))
        whiten[j] = np.linalg.inv(low).T
        logdet[j] = 2 * np.log(np.diag(low)).sum()
    return nk / n, centres, whiten, logdet, nk


def _coefficients(weights: np.ndarray, centres: np.ndarray, whiten: np.ndarray, logdet: np.ndarray) -> np.ndarray:
    """Of every component's log weight plus log density, over the :func:`_monomials` of a row."""
    k, d = centres.shape
    a, b = np.triu_indices(d)
    out = np.empty((k, 1 + d + len(a)))
    for j in range(k):
        inverse = whiten[j] @ whiten[j].T
        pull = inverse @ centres[j]
        out[j, 0] = np.log(weights[j] + 1e-300) - 0.5 * (centres[j] @ pull + logdet[j] + d * np.log(2 * np.pi))
        out[j, 1 : d + 1] = pull
        out[j, d + 1 :] = np.where(a == b, -0.5, -1.0) * inverse[a, b]
    return out


def fit_mixture(vectors: DataFrame, components: tuple[int, ...] = COMPONENTS, dims: int = 48, shrink: float = 0.1, iterations: int = 12, seed: int = 5) -> Mixture | None:
    """The mixture with the best information criterion over the unit vectors; None for no vectors.

    Everything is taken over all rows, as sums that are combined before they reach the driver: mean, scale and
    covariance (for standardising and reducing), and every step of the expectation-maximisation, in which one pass
    serves all numbers of components.  It starts from distant rows: a few passes draw rows by their distance from
    those drawn so far, one counts the rows next to each, and these counts weigh them in the choice of the centres.
    """
    spark = vectors.sparkSession
    head = vectors.select("vec").first()
    if head is None:
        return None
    d = len(head.vec)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = unit_matrix(b["vec"]) if len(b) else np.zeros((0, d))
            n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        yield pd.DataFrame({"pos": np.arange(1 + d + d * d), "val": np.concatenate([[n], s, c.ravel()])})

    total = map_frames(vectors.select("vec"), sums, "pos int, val double").groupBy("pos").agg(F.sum("val").alias("val"))
    flat = np.zeros(1 + d + d * d)
    for r in few_or_raise(total, len(flat), "moments"):
        flat[r.pos] = r.val
    n = int(flat[0])
    mean = flat[1 : d + 1] / n
    cov = flat[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    dims = min(dims, d)
    basis = axes[:, ::-1][:, :dims]
    floor = 1e-4 * max(values[::-1][:dims].mean(), 0.0) + 1e-9

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = ((unit_matrix(b["vec"]) - mean) / scale) @ basis
                yield pd.DataFrame({"ids": [b["id"].to_numpy(np.int64).tobytes()], "z": [z.tobytes()]})

    cuts = Cuts(spark, "mixture")
    kept = cuts.cut(map_frames(vectors.select("id", "vec"), reduce, "ids binary, z binary"))
    # as many tasks as run at once, for each brings sums of its own
    reduced = kept.coalesce(max(1, spark.sparkContext.defaultParallelism))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for ids, z in zip(b["ids"], b["z"]):
                ids, z = np.frombuffer(ids, np.int64), np.frombuffer(z, np.float64).reshape(-1, dims)
                for i in range(0, len(z), 2048):
                    yield ids[i : i + 2048], z[i : i + 2048]

    # the rows are drawn without replacement, by the least of exponential times over squared distances
    each = 2 * max(components)
    drawn = np.zeros((1, dims))
    for salt in range(seed, seed + 3):

        def draw(batches: Iterator[pd.DataFrame], drawn=drawn, salt=salt) -> Iterator[pd.DataFrame]:
            keys, rows = np.zeros(0), np.zeros((0, dims))
            for ids, z in features(batches):
                far = _squared_distances(z, drawn).min(1)
                at = np.nonzero(far > 1e-12)[0]
                keys, rows = np.concatenate([keys, -np.log(_uniform(ids[at], salt)) / far[at]]), np.concatenate([rows, z[at]])
                keep = np.argsort(keys, kind="stable")[:each]
                keys, rows = keys[keep], rows[keep]
            yield pd.DataFrame({"key": keys, "z": [r.tobytes() for r in rows]})

        got = map_frames(reduced, draw, "key double, z binary").orderBy("key", "z").limit(each).collect()
        if not got:
            break
        drawn = np.unique(np.concatenate([drawn, [np.frombuffer(r.z, np.float64) for r in got]]), axis=0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = np.zeros(len(drawn))
        for _, z in features(batches):
            near += np.bincount(_squared_distances(z, drawn).argmin(1), minlength=len(drawn))
        yield pd.DataFrame({"pos": np.arange(len(drawn)), "val": near})

    weights = np.zeros(len(drawn))
    for r in few_or_raise(map_frames(reduced, count, "pos int, val double").groupBy("pos").agg(F.sum("val").alias("val")), len(drawn), "counts of starting rows"):
        weights[r.pos] = r.val
    drawn, weights = drawn[weights > 0], weights[weights > 0]
    size = 1 + dims + dims * (dims + 1) // 2

    def moments(scores: dict[int, tuple[np.ndarray, bool]]) -> dict[int, tuple[float, np.ndarray]]:
        """Log-likelihood and sums of moments over all rows, by number of components; the scores are linear in the
        monomials, hard ones give a row to its best component."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = {k: np.zeros((k, size)) for k in scores}
            ll = dict.fromkeys(scores, 0.0)
            for _, z in features(batches):
                phi = _monomials(z)
                for k, (score, hard) in scores.items():
                    parts = phi @ score.T
                    top = parts.max(1, keepdims=True)
                    if hard:
                        resp = np.zeros_like(parts)
                        resp[np.arange(len(z)), parts.argmax(1)] = 1.0
                    else:
                        resp = np.exp(parts - top)
                        total = resp.sum(1, keepdims=True)
                        resp /= total
                        ll[k] += float((top + np.log(total)).sum())
                    acc[k] += resp.T @ phi
            yield pd.DataFrame({"k": list(acc), "ll": [ll[k] for k in acc], "sums": [acc[k].tobytes() for k in acc]})

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float64) for x in pdf["sums"])
            return pd.DataFrame({"k": pdf["k"].iloc[:1], "ll": [pdf["ll"].sum()], "sums": [total.tobytes()]})

        got = map_frames(reduced, add, "k int, ll double, sums binary").groupBy("k").applyInPandas(merge, "k int, ll double, sums binary")
        return {r.k: (r.ll, np.frombuffer(r.sums, np.float64).reshape(r.k, size)) for r in few_or_raise(got, len(scores), "numbers of components")}

    hard = {}
    for k in sorted({min(k, len(drawn)) for k in components}):
        c = _seeds(drawn, weights, k, seed)
        hard[k] = (np.concatenate([-0.5 * (c**2).sum(1)[:, None], c, np.zeros((k, size - 1 - dims))], axis=1), True)
    now = {k: (-np.inf, _maximised(m, n, dims, shrink, floor)) for k, (_, m) in moments(hard).items()}
    open_ = set(now)
    for i in range(iterations):
        got = moments({k: (_coefficients(*now[k][1][:4]), False) for k in sorted(open_)})
        for k, (ll, m) in got.items():
            last = now[k][0]
            if ll - last < 1e-4 * abs(ll) or i == iterations - 1:
                now[k] = (ll, now[k][1])
                open_.discard(k)
            else:
                now[k] = (ll, _maximised(m, n, dims, shrink, floor))
        if not open_:
            break
    cuts.drop(kept)

    def criterion(k: int) -> float:
        # free parameters: weights, centres, covariances (as many as their rows can carry)
        ll, (*_, nk) = now[k]
        return -2 * ll + (k - 1 + k * dims + np.minimum(dims * (dims + 1) / 2, nk).sum()) * np.log(n)

    best = min(now, key=criterion)
    w, c, wh, ld, _ = now[best][1]
    return Mixture(mean, scale, basis, w, c, wh, ld, criterion(best))


def assign(vectors: DataFrame, mixture: Mixture) -> DataFrame:
    """``id, component, membership, density`` of every row: the likeliest component, its posterior
    probability and the row's log density under it."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            parts = mixture.log_parts(mixture.features(unit_matrix(b["vec"])))
            best = parts.argmax(1)
            top = parts[np.arange(len(b)), best]
            yield pd.DataFrame({"id": b["id"], "component": best.astype(np.int32), "membership": 1 / np.exp(parts - top[:, None]).sum(1), "density": top - np.log(mixture.weights[best] + 1e-300)})

    return map_frames(vectors.select("id", "vec"), look, "id long, component int, membership double, density double")


def _merge(n: int, pairs) -> np.ndarray:
    """Roots of a union-find over 0..n-1."""
    root = np.arange(n)

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def similarity_clusters(vectors: DataFrame, least: float = 0.6, pivots_each: int = 8, mixture: Mixture | None = None, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """Chains of rows in which neighbours have at least the cosine ``least``.

    Returns ``id, cluster_key, cluster_size, component, membership, density`` for every vector;
    ``cluster_key`` is the smallest id of the cluster.  The result is exact, whatever the mixture.

    1. Every row is linked to the pivots (the densest members of all components, at most
       ``components * pivots_each``) that it is similar to; pivots that share a row are one cell.
    2. Two cells are one cluster if any two of their rows are similar.  In the plane of the two
       centres the product of two rows is at most a a' + b b' + r r' (r: what lies outside the
       plane); rows that cannot reach ``least`` with the greatest values of the other cell are
       dropped, the few others compared.
    3. Rows that no pivot sees are compared with each other, and with the rows of every cell whose
       cone they can reach, in blocks.  This is the only part whose work can grow with the square,
       of the rows no pivot sees.
    """
    spark = vectors.sparkSession
    cuts = Cuts(spark, "clusters")
    mixture = mixture or fit_mixture(vectors)
    if mixture is None:
        return vectors.select("id", F.col("id").alias("cluster_key"), F.lit(1).cast("long").alias("cluster_size"), F.lit(0).alias("component"), F.lit(1.0).alias("membership"), F.lit(0.0).alias("density"))
    rows = cuts.cut(assign(vectors, mixture))
    dense = rows.withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("density"), "id"))).where(F.col("n") <= pivots_each)
    top = few_or_raise(dense.select("id").join(vectors, "id").select("id", "vec"), len(mixture.weights) * pivots_each, "pivots")
    top.sort(key=lambda r: r.id)
    pivots = unit_matrix([r.vec for r in top])
    first = _merge(len(pivots), np.argwhere(np.triu(pivots @ pivots.T >= least, 1)))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = unit_matrix(b["vec"]) @ pivots.T
                best = s.argmax(1)
                seen = s[np.arange(len(s)), best] >= least
                extra = set()
                for r in np.nonzero((s >= least).sum(1) > 1)[0]:
                    roots = np.unique(first[s[r] >= least])
                    extra.update((int(roots[0]), int(x)) for x in roots[1:])
                yield pd.DataFrame({"id": b["id"], "cell": np.where(seen, first[best], -1).astype(np.int32), "join": [[]] * len(b)})
                if extra:
                    yield pd.DataFrame({"id": [None], "cell": np.array([-2], np.int32), "join": [[x for p in sorted(extra) for x in p]]}).astype({"id": "Int64"})

    linked = cuts.cut(map_frames(vectors.select("id", "vec"), link, "id long, cell int, join array<int>"))
    joins = few_or_raise(linked.where("cell = -2").select(F.explode(F.expr("transform(sequence(0, size(join) div 2 - 1), i -> struct(join[2*i] as a, join[2*i+1] as b))")).alias("p")).select("p.a", "p.b").distinct(), len(pivots) ** 2, "pivot joins")
    second = _merge(len(pivots), [(r.a, r.b) for r in joins])
    cell_of = {int(p): int(second[first[p]]) for p in range(len(pivots))}
    names = sorted(set(cell_of.values()))
    number = {c: i for i, c in enumerate(names)}
    to_cell = np.array([number[cell_of[p]] for p in range(len(pivots))])
    n_cells = len(names)
    # the centres: any directions are right, good ones prune better
    centres = np.zeros((n_cells, pivots.shape[1]))
    for p in range(len(pivots)):
        centres[to_cell[p]] += pivots[p]
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    g = np.clip(centres @ centres.T, -1, 1)
    away = np.sqrt(np.maximum(1 - g * g, 1e-12))

    def cell(x: np.ndarray) -> np.ndarray:
        s = x @ pivots.T
        best = s.argmax(1)
        return np.where(s[np.arange(len(s)), best] >= least, to_cell[best], -1)

    def plane(x: np.ndarray, dots: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Coordinates (a, b, r) of rows in the plane of the centres lo < hi."""
        a = dots[:, lo]
        b = (dots[:, hi] - g[lo, hi] * a) / away[lo, hi]
        return np.stack([a, b, np.sqrt(np.maximum(1 - a * a - b * b, 0.0))])

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Greatest and least coordinates of every cell in its plane with every other."""
        acc: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            x = unit_matrix(b["vec"])
            c, dots = cell(x), x @ centres.T
            for own in np.unique(c[c >= 0]):
                xs, ds = x[c == own], dots[c == own]
                for other in range(n_cells):
                    if other == own:
                        key, val = (own, own), np.array([ds[:, own].min(), 0, 0, 0, 0, 0])
                    else:
                        p = plane(xs, ds, min(own, other), max(own, other))
                        key, val = (own, other), np.concatenate([p.max(1), -p.min(1)])
                    if key in acc:
                        acc[key] = np.minimum(acc[key], val) if other == own else np.maximum(acc[key], val)
                    else:
                        acc[key] = val
        if acc:
            ks = list(acc)
            vals = np.stack([acc[k] for k in ks])
            yield pd.DataFrame({"own": [int(k[0]) for k in ks], "other": [int(k[1]) for k in ks], **{f"m{i}": vals[:, i] for i in range(6)}})

    ext = map_frames(vectors.select("vec"), extremes, "own int, other int, " + ", ".join(f"m{i} double" for i in range(6)))
    ext = ext.groupBy("own", "other").agg(*[F.max(f"m{i}").alias(f"m{i}") for i in range(6)], F.min("m0").alias("least"))
    high = np.full((n_cells, n_cells, 3), -2.0)
    low = np.full((n_cells, n_cells, 3), 2.0)
    cone = np.zeros(n_cells)
    for r in few_or_raise(ext, n_cells * n_cells, "cell extremes"):
        if r.own == r.other:
            cone[r.own] = np.arccos(np.clip(r.least, -1, 1))
        else:
            high[r.own, r.other] = r.m0, r.m1, r.m2
            low[r.own, r.other] = -r.m3, -r.m4, -r.m5
    reach = np.arccos(least)
    tiny = 1e-9

    def survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows that may be similar to some row of another cell, and rows no pivot sees."""
        for b in batches:
            if not len(b):
                continue
            x = unit_matrix(b["vec"])
            ids = b["id"].to_numpy()
            c, dots = cell(x), x @ centres.T
            out: list[pd.DataFrame] = []
            for own in np.unique(c[c >= 0]):
                at = np.nonzero(c == own)[0]
                for other in range(n_cells):
                    if other == own:
                        continue
                    p = plane(x[at], dots[at], min(own, other), max(own, other))
                    bound = np.zeros(len(at))
                    for i in range(3):
                        bound += np.maximum(p[i] * high[other, own, i], p[i] * low[other, own, i])
                    keep = at[bound >= least - tiny]
                    if len(keep):
                        out.append(pd.DataFrame({"lo": min(own, other), "hi": max(own, other), "side": int(own > other), "id": ids[keep], "v": [x[r].tobytes() for r in keep]}))
            for r in np.nonzero(c < 0)[0]:
                out.append(pd.DataFrame({"lo": [-1], "hi": [-1], "side": [0], "id": [ids[r]], "v": [x[r].tobytes()]}))
            if out:
                yield pd.concat(out).astype({"lo": "int32", "hi": "int32", "side": "int32"})

    alive = cuts.cut(map_frames(vectors.select("id", "vec"), survivors, "lo int, hi int, side int, id long, v binary"))
    sizes = {(r.lo, r.hi, r.side): r.n for r in few_or_raise(alive.groupBy("lo", "hi", "side").agg(F.count("*").alias("n")), 2 * n_cells * n_cells + 1, "cell pairs")}
    blocks_of = {k: -(-n // block_rows) for k, n in sizes.items()}
    dim = pivots.shape[1]

    def matrix(vs) -> np.ndarray:
        return np.frombuffer(b"".join(vs), dtype=np.float64).reshape(-1, dim)

    # cells against cells, in blocks of the one by blocks of the other
    pair_keys = [k for k in sizes if k[0] >= 0 and k[2] == 0 and (k[0], k[1], 1) in sizes]
    edges = None
    if pair_keys:
        ok = spark.createDataFrame([(lo, hi, blocks_of[lo, hi, 0], blocks_of[lo, hi, 1]) for lo, hi, _ in pair_keys], "lo int, hi int, n0 int, n1 int")
        a = alive.join(F.broadcast(ok), ["lo", "hi"])
        own0, own1 = F.expr("cast(pmod(id, n0) as int)"), F.expr("cast(pmod(id, n1) as int)")
        spread = a.where("side = 0").withColumn("b0", own0).withColumn("b1", F.explode(F.expr("sequence(0, n1 - 1)"))).unionByName(
            a.where("side = 1").withColumn("b1", own1).withColumn("b0", F.explode(F.expr("sequence(0, n0 - 1)")))
        )

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            p, q = pdf[pdf.side == 0], pdf[pdf.side == 1]
            hit = False
            if len(p) and len(q):
                y = matrix(q["v"])
                px = matrix(p["v"])
                hit = any((px[i : i + 512] @ y.T >= least).any() for i in range(0, len(px), 512))
            return pd.DataFrame({"a": [-1 - int(pdf.lo.iloc[0])], "b": [-1 - int(pdf.hi.iloc[0])]}) if hit else pd.DataFrame({"a": [], "b": []}).astype("int64")

        edges = spread.select("lo", "hi", "b0", "b1", "side", "id", "v").groupBy("lo", "hi", "b0", "b1").applyInPandas(meet, "a long, b long")
    loners = sizes.get((-1, -1, 0), 0)
    if loners:
        lone_blocks = blocks_of[-1, -1, 0]
        per_cell = {r.cell: r.n for r in few_or_raise(linked.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n")), len(pivots), "cells")}
        cell_rows = np.zeros(n_cells, int)
        for p, n in per_cell.items():
            cell_rows[to_cell[p]] += n
        nb = np.maximum(1, -(-cell_rows // block_rows))

        def spread_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = unit_matrix(b["vec"])
                ids = b["id"].to_numpy()
                c, dots = cell(x), x @ centres.T
                k, blk, qblk, role, row = [], [], [], [], []
                angle = np.arccos(np.clip(dots, -1, 1))

                def put(cell_, block_, qblock_, role_, row_):
                    k.append(cell_), blk.append(block_), qblk.append(qblock_), role.append(role_), row.append(row_)

                for r in range(len(x)):
                    where, n_blocks = (c[r], nb[c[r]]) if c[r] >= 0 else (-1, lone_blocks)
                    for q in range(lone_blocks):
                        put(where, ids[r] % n_blocks, q, 0, r)
                    if c[r] >= 0:
                        continue
                    mine = ids[r] % lone_blocks
                    for o in range(lone_blocks):
                        put(-1, o, mine, 1, r)
                    for g_ in np.nonzero(angle[r] <= reach + cone + 1e-7)[0]:
                        for o in range(nb[g_]):
                            put(g_, o, mine, 1, r)
                yield pd.DataFrame({"cell": np.array(k, np.int32), "block": np.array(blk, np.int32), "qblock": np.array(qblk, np.int32), "role": np.array(role, np.int8), "id": ids[row], "v": [x[r].tobytes() for r in row]})

        def lone(pdf: pd.DataFrame) -> pd.DataFrame:
            own, q = pdf[pdf.role == 0], pdf[pdf.role == 1]
            out: list[tuple[int, int]] = []
            where = int(pdf.cell.iloc[0])
            if len(own) and len(q):
                y, oid, qid = matrix(own["v"]), own["id"].to_numpy(), q["id"].to_numpy()
                x = matrix(q["v"])
                for i in range(0, len(x), 512):
                    hit = x[i : i + 512] @ y.T >= least
                    if where >= 0:
                        out += [(int(t), -1 - where) for t in qid[i : i + 512][hit.any(1)]]
                    else:
                        out += [(int(qid[i + r]), int(oid[j])) for r, j in np.argwhere(hit) if qid[i + r] < oid[j]]
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

        more = map_frames(vectors.select("id", "vec"), spread_all, "cell int, block int, qblock int, role byte, id long, v binary").groupBy("cell", "block", "qblock").applyInPandas(lone, "a long, b long")
        edges = more if edges is None else edges.unionByName(more)
    # a row's node: its cell (as a negative number), or itself
    cells = spark.createDataFrame([(int(first[p]), -1 - int(to_cell[p])) for p in range(len(pivots))], "cell int, node long").distinct()
    nodes = linked.where("cell > -2").select("id", "cell").join(F.broadcast(cells), "cell", "left").select("id", F.coalesce("node", "id").alias("node"))
    if edges is not None:
        edges = cuts.cut(edges.distinct())
        if not edges.isEmpty():
            comp = connected_components(edges, "a", "b").select(F.col("id").alias("node"), F.col("component").alias("to"))
            nodes = nodes.join(comp, "node", "left").select("id", F.coalesce("to", "node").alias("node"))
    nodes = cuts.cut(nodes)
    keys = nodes.groupBy("node").agg(F.min("id").alias("cluster_key"), F.count("*").alias("cluster_size"))
    return nodes.join(keys, "node").join(rows, "id").select("id", "cluster_key", "cluster_size", "component", "membership", "density")
