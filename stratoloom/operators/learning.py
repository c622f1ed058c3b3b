"""Clustering, reduction, outlier and defect models over vectors and features.

Models are small (centres, trees, coefficients) and travel with the tasks; rows are read where they lie.
Sums over all rows are combined before they reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts, few_or_raise, map_frames, ship

#: Starting centres, cluster-number sweeps and forests are fitted on at most about this many rows.
SAMPLE_ROWS = 20_000
#: Groups beyond this raise in operators that need a distance matrix.
MOST_GROUP_ROWS = 6_000


def _stack(vs) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vs]) if len(vs) else np.zeros((0, 1))


def bounded_sample(df: DataFrame, id_col: str, vec: str, most: int = SAMPLE_ROWS) -> np.ndarray:
    """About ``most`` vectors chosen by a hash of the id, in order of id (all, if there are fewer)."""
    ok = df.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull())
    n = ok.count()
    if n > most:
        ok = ok.where(F.expr(f"pmod(xxhash64(`{id_col}`, 5), {n}) < {most}"))
    rows = few_or_raise(ok.select(F.col(id_col).alias("i"), F.col(vec).alias("v")), 2 * most + 100, "sample")
    return _stack([r.v for r in sorted(rows, key=lambda r: r.i)])


def kmeans_pp(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Starting centres: each next row drawn with the squared distance to those chosen."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        i = int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x)))
        chosen.append(i)
        d = np.minimum(d, ((x - x[i]) ** 2).sum(1))
    return x[chosen]


def _memberships(x: np.ndarray, c: np.ndarray, m: float) -> np.ndarray:
    d2 = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 1e-8)
    # the exponent applies to squared distances
    u = d2 ** (-1 / (m - 1))
    return u / u.sum(1, keepdims=True)


def fuzzy_c_means(df: DataFrame, id_col: str, vec: str, k: int, m: float = 2.0, iterations: int = 100, tolerance: float = 1e-5, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """``(memberships, centres)``: ``id, cluster, membership`` for every row and cluster (rows sum to 1).

    Every iteration reads all rows once and brings k weighted sums to the driver.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    c = kmeans_pp(bounded_sample(df, id_col, vec), k, seed)
    k, dim = c.shape
    for _ in range(iterations):
        now = c

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            acc = np.zeros((k, dim + 1))
            for b in batches:
                if len(b):
                    x = _stack(b["v"])
                    u = _memberships(x, now, m) ** m
                    acc += np.concatenate([u.T @ x, u.sum(0)[:, None]], axis=1)
            yield pd.DataFrame({"pos": np.arange(acc.size), "val": acc.ravel()})

        flat = np.zeros(k * (dim + 1))
        for r in few_or_raise(map_frames(rows.select("v"), sums, "pos int, val double").groupBy("pos").agg(F.sum("val").alias("val")), len(flat), "cluster sums"):
            flat[r.pos] = r.val
        acc = flat.reshape(k, dim + 1)
        c = acc[:, :dim] / np.maximum(acc[:, dim:], 1e-12)
        if np.abs(c - now).max() < tolerance:
            break
    final = c

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = _memberships(_stack(b["v"]), final, m)
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), k), "cluster": np.tile(np.arange(k, dtype=np.int32), len(b)), "membership": u.ravel()})

    return map_frames(rows, look, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, membership double"), final


def estimate_k(n: int, least_cluster: int = 10) -> int:
    """``round(sqrt(n / least_cluster))`` within 10 and 100."""
    return max(10, min(100, round(math.sqrt(n / least_cluster))))


def xie_beni(x: np.ndarray, c: np.ndarray, m: float = 2.0) -> float:
    """Compactness over separation: the lower, the better."""
    d2 = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    gap = ((c[:, None, :] - c[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(gap, np.inf)
    return float((_memberships(x, c, m) ** m * d2).sum() / (len(x) * max(gap.min(), 1e-12)))


def sweep_k(x: np.ndarray, ks: list[int], m: float = 2.0, iterations: int = 20, seed: int = 42) -> list[tuple[int, float]]:
    """(k, Xie-Beni index) over a bounded sample."""
    out = []
    for k in ks:
        c = kmeans_pp(x, k, seed)
        for _ in range(iterations):
            u = _memberships(x, c, m) ** m
            c = u.T @ x / u.sum(0)[:, None]
        out.append((k, xie_beni(x, c, m)))
    return out


def principal_components(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """``id, features``: the rows on the first ``k`` principal axes (signs: greatest loading positive).

    Mean and covariance are sums over all rows; only they reach the driver.
    """
    head = df.where(F.col(vec).isNotNull()).select(vec).first()
    dim = len(head[0]) if head else 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(1 + dim + dim * dim)
        for b in batches:
            if len(b):
                x = _stack(b["v"])
                acc += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"pos": np.arange(acc.size), "val": acc})

    rows = df.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    flat = np.zeros(1 + dim + dim * dim)
    for r in few_or_raise(map_frames(rows.select("v"), sums, "pos int, val double").groupBy("pos").agg(F.sum("val").alias("val")), len(flat), "moments"):
        flat[r.pos] = r.val
    n = max(flat[0], 1)
    mean = flat[1 : dim + 1] / n
    _, axes = np.linalg.eigh(flat[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "features": list((_stack(b["v"]) - mean) @ axes)})

    return map_frames(rows, look, f"id {rows.schema['id'].dataType.simpleString()}, features array<double>")


def random_projection(df: DataFrame, id_col: str, vec: str, k: int, seed: int = 42) -> DataFrame:
    """``id, features``: the rows times a seeded Gaussian matrix over the square root of ``k``."""
    head = df.where(F.col(vec).isNotNull()).select(vec).first()
    dim = len(head[0]) if head else 1
    p = np.random.default_rng(seed).standard_normal((dim, k)) / math.sqrt(k)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "features": list(_stack(b["v"]) @ p)})

    rows = df.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    return map_frames(rows, look, f"id {rows.schema['id'].dataType.simpleString()}, features array<double>")


def _hdbscan(x: np.ndarray, least_cluster: int, least_samples: int) -> np.ndarray:
    """Labels (-1 noise) by mutual reachability, minimum spanning tree, condensed tree and excess of mass."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1), 0))
    core = np.sort(d, axis=1)[:, min(least_samples, n - 1)]
    d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    seen, best, frm, tree = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    cur = 0
    for _ in range(n - 1):
        seen[cur] = True
        closer = (d[cur] < best) & ~seen
        best[closer], frm[closer] = d[cur][closer], cur
        nxt = int(np.where(seen, np.inf, best).argmin())
        tree.append((best[nxt], frm[nxt], nxt))
        cur = nxt
    tree.sort()
    # single-linkage dendrogram: node n + i joins two nodes at a distance
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (w, a, b) in enumerate(tree):
        a, b = find(a), find(b)
        kids[n + i] = (a, b, w)
        parent[a] = parent[b] = n + i
        size[n + i] = size[a] + size[b]

    def leaves(v):
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            if u < n:
                out.append(u)
            else:
                todo += kids[u][:2]
        return out

    # condensed tree: clusters with their birth, and what falls out of them
    birth, stability, children, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: leaves(2 * n - 2)}
    todo, fresh = [(2 * n - 2, 0)], 1
    while todo:
        v, c = todo.pop()
        if v < n:
            continue
        a, b, w = kids[v]
        lam = 1 / max(w, 1e-12)
        big = [u for u in (a, b) if size[u] >= least_cluster]
        if len(big) == 2:
            stability[c] += (lam - birth[c]) * size[v]
            for u in big:
                birth[fresh], stability[fresh], children[fresh], members[fresh] = lam, 0.0, [], leaves(u)
                children[c].append(fresh)
                todo.append((u, fresh))
                fresh += 1
        elif len(big) == 1:
            stability[c] += (lam - birth[c]) * (size[v] - size[big[0]])
            todo.append((big[0], c))
        else:
            stability[c] += (lam - birth[c]) * size[v]
    chosen: set[int] = set()
    value = dict(stability)
    for c in range(fresh - 1, 0, -1):
        sub = sum(value[k] for k in children[c])
        if children[c] and sub > stability[c]:
            value[c] = sub
        else:
            chosen.add(c)
    label = np.full(n, -1)
    picked = 0
    todo2 = list(children[0])
    while todo2:
        c = todo2.pop(0)
        if c in chosen:
            label[members[c]] = picked
            picked += 1
        else:
            todo2 += children[c]
    return label


def hdbscan(df: DataFrame, group: str, id_col: str, vec: str, least_cluster: int = 5, least_samples: int = 5) -> DataFrame:
    """Density clusters within each group: ``group, id, cluster`` (-1 noise).

    Needs the distance matrix of a group in a worker; groups over :data:`MOST_GROUP_ROWS` rows raise.
    """
    ship(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_GROUP_ROWS:
            raise ValueError(f"group {pdf['g'].iloc[0]!r} has more than {MOST_GROUP_ROWS} rows")
        pdf = pdf.sort_values("id")
        return pd.DataFrame({group: pdf["g"], "id": pdf["id"], "cluster": _hdbscan(_stack(pdf["v"]), least_cluster, least_samples).astype(np.int32)})

    d = df.where(F.col(vec).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(vec).alias("v"))
    return d.groupBy("g").applyInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, id {df.schema[id_col].dataType.simpleString()}, cluster int")


def isolation_scores(df: DataFrame, id_col: str, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation-forest scores ``id, score`` (near 1: outlier); null features count as 0.

    The trees are grown on bounded random subsets of a sample; every row is scored.
    """
    cols = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    d = df.select(F.col(id_col).alias("id"), cols.alias("v"))
    x = bounded_sample(d, "id", "v")
    rng = np.random.default_rng(seed)
    m = min(sample, len(x))
    limit = math.ceil(math.log2(max(m, 2)))

    def c(n: float) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)

    def grow(rows: np.ndarray, depth: int):
        spread = np.nonzero(rows.max(0) > rows.min(0))[0] if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            return (-1, depth + c(len(rows)), None, None)
        f = int(rng.choice(spread))
        at = rng.uniform(rows[:, f].min(), rows[:, f].max())
        return (f, at, grow(rows[rows[:, f] < at], depth + 1), grow(rows[rows[:, f] >= at], depth + 1))

    forest = [grow(x[rng.choice(len(x), m, replace=False)], 0) for _ in range(trees)] if len(x) else []

    def depth(tree, rows: np.ndarray) -> np.ndarray:
        f, at, lo, hi = tree
        if f < 0:
            return np.full(len(rows), at)
        out, left = np.empty(len(rows)), rows[:, f] < at
        if left.any():
            out[left] = depth(lo, rows[left])
        if not left.all():
            out[~left] = depth(hi, rows[~left])
        return out

    norm = c(m) or 1.0

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows = _stack(b["v"])
                yield pd.DataFrame({"id": b["id"], "score": 2 ** (-np.mean([depth(t, rows) for t in forest], axis=0) / norm)})

    return map_frames(d, look, f"id {d.schema['id'].dataType.simpleString()}, score double")


def logistic_by_group(df: DataFrame, group: str, id_col: str, features: list[str], label: str, rounds: int = 2000, rate: float = 0.3) -> DataFrame:
    """Logistic regression within each group by gradient descent on standardised features: ``group, id, probability``.

    Null features count as 0; a group with one class only has its share as everyone's probability.
    """
    ship(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[[f"f{i}" for i in range(len(features))]].to_numpy(float)
        y = pdf["y"].to_numpy(float)
        x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        if y.min() == y.max():
            p = np.full(len(y), y.mean())
        else:
            a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            w = np.zeros(a.shape[1])
            for _ in range(rounds):
                w -= rate * a.T @ (1 / (1 + np.exp(-np.clip(a @ w, -35, 35))) - y) / len(y)
            p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        return pd.DataFrame({group: pdf["g"], "id": pdf["id"], "probability": p})

    d = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    return d.where("y is not null").groupBy("g").applyInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, id {df.schema[id_col].dataType.simpleString()}, probability double")


# ---- time series ------------------------------------------------------------
def move_split_merge(a: np.ndarray, b: np.ndarray, cost: float = 0.1) -> float:
    """Move-split-merge distance of two series."""

    def step(new: float, x: float, y: float) -> float:
        return cost if min(x, y) <= new <= max(x, y) else cost + min(abs(new - x), abs(new - y))

    n, m = len(a), len(b)
    if not n or not m:
        return 0.0 if n == m else math.inf
    d = np.empty((n, m))
    d[0, 0] = abs(a[0] - b[0])
    for i in range(1, n):
        d[i, 0] = d[i - 1, 0] + step(a[i], a[i - 1], b[0])
    for j in range(1, m):
        d[0, j] = d[0, j - 1] + step(b[j], a[0], b[j - 1])
    for i in range(1, n):
        for j in range(1, m):
            d[i, j] = min(d[i - 1, j - 1] + abs(a[i] - b[j]), d[i - 1, j] + step(a[i], a[i - 1], b[j]), d[i, j - 1] + step(b[j], a[i], b[j - 1]))
    return float(d[-1, -1])


def _split_merge(p: list[np.ndarray], q: list[np.ndarray], cost: float) -> np.ndarray:
    """Distances of series whose values at each time are in ``p`` and ``q``, arrays that are broadcast together."""

    def step(new: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # how far the value lies outside the two others
        return cost + np.maximum(np.maximum(np.minimum(x, y) - new, new - np.maximum(x, y)), 0.0)

    row = [np.abs(p[0] - q[0])]
    for j in range(1, len(q)):
        row.append(row[-1] + step(q[j], p[0], q[j - 1]))
    for i in range(1, len(p)):
        new = [row[0] + step(p[i], p[i - 1], q[0])]
        for j in range(1, len(q)):
            split = np.minimum(row[j] + step(p[i], p[i - 1], q[j]), new[-1] + step(q[j], p[i], q[j - 1]))
            new.append(np.minimum(row[j - 1] + np.abs(p[i] - q[j]), split))
        row = new
    return row[-1]


def move_split_merge_all(a: np.ndarray, b: np.ndarray, cost: float = 0.1) -> np.ndarray:
    """:func:`move_split_merge` of every row of ``a`` (series of one length) with every row of ``b`` (of one length)."""
    n, m = a.shape[1], b.shape[1]
    if not n or not m:
        return np.full((len(a), len(b)), 0.0 if n == m else math.inf)
    return _split_merge([a[:, i, None] for i in range(n)], [b[None, :, j] for j in range(m)], cost)


def move_split_merge_pairs(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, cost: float = 0.1) -> np.ndarray:
    """:func:`move_split_merge` of the series ``a[i]`` and ``b[j]``, pair by pair; infinite where it is no number."""
    n, m = (np.array([len(v) for v in vs], np.int64)[at] for vs, at in ((a, i), (b, j)))
    flat = [np.concatenate([np.zeros(0), *vs]) for vs in (a, b)]
    begin = [np.concatenate([[0], np.cumsum([len(v) for v in vs])])[at].astype(np.int64) for vs, at in ((a, i), (b, j))]
    d = np.where(n == m, 0.0, math.inf)
    order = np.lexsort((m, n))
    for at in np.split(order, np.nonzero(np.diff(n[order]) | np.diff(m[order]))[0] + 1):
        if len(at) and n[at[0]] and m[at[0]]:
            for part in np.split(at, range(8192, len(at), 8192)):
                p, q = ([x[g[part] + t] for t in range(many[at[0]])] for x, g, many in zip(flat, begin, (n, m)))
                d[part] = _split_merge(p, q, cost)
    d[np.isnan(d)] = math.inf
    return d


def _shape_of(vs: list[np.ndarray]) -> np.ndarray:
    """Values of each series that a move by x changes by x at most and a split or merge leaves as they are: ends, extremes and all rises."""
    return np.array([(v[0], v[-1], v.max(), v.min(), v[0] + np.maximum(np.diff(v), 0).sum()) if len(v) else (0.0,) * 5 for v in vs]).reshape(-1, 5)


def series_neighbours(series: DataFrame, probes: DataFrame | list[tuple], id_col: str, values: str, k: int, cost: float = 0.1, block: int = 32_768, probe_block: int = 256) -> DataFrame:
    """The ``k`` nearest series of every probe: ``probe, id, distance``; ties go to the smaller id.

    Both tables have ``id_col`` and ``values`` (probes may be a list of such pairs); null values are dropped.  Series
    with the same values are compared once, with the ``k`` smallest of their ids; where there are ``k`` of them, they are
    the nearest.  Blocks of series meet blocks of probes; each block keeps its best, and only those are ranked together.
    A pair is left out if its lengths, ends, extremes or rises alone are further apart than the ``k`` best so far.
    """
    kind = series.schema[id_col].dataType.simpleString()
    if isinstance(probes, list):
        probes = series.sparkSession.createDataFrame([(p, [float(x) for x in v]) for p, v in probes], f"`{id_col}` {kind}, `{values}` array<double>")
    s, q = (df.where(F.col(values).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(values).cast("array<double>").alias("v")) for df in (series, probes))

    from .windows import top_per_group

    cuts = Cuts(series.sparkSession, "series-neighbours")
    base = cuts.cut(top_per_group(s, ["v"], [F.col("id")], k).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    # only equal series are at distance 0, and those of numbers always are
    same = base.where((F.size("ids") >= k) & F.forall("v", lambda x: F.abs(x) < math.inf) & F.lit(cost > 0))
    asked = cuts.cut(q.select("v").distinct().join(same, "v", "left_anti"))
    nb, nq = max(1, -(-base.count() // block)), max(1, -(-asked.count() // probe_block))
    own = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = base.select("ids", "v", F.lit(0).alias("side"), own(nb).alias("b"), each(nq).alias("qb")).unionByName(asked.select(F.lit(None).cast(f"array<{kind}>").alias("ids"), "v", F.lit(1).alias("side"), each(nb).alias("b"), own(nq).alias("qb")))

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        ids, xs, ys = pdf["ids"][pdf["side"] == 0].to_list(), *([np.asarray(v, float) for v in pdf["v"][pdf["side"] == side]] for side in (0, 1))
        if xs and ys:
            many, sizes, wide = np.array([len(i) for i in ids]), np.array([len(x) for x in xs]), _shape_of(xs)
            for lo in range(0, len(ys), 16):
                part = ys[lo : lo + 16]
                with np.errstate(invalid="ignore"):
                    apart = np.abs(_shape_of(part)[:, None] - wide).max(2)
                least = np.where(np.isnan(apart), 0.0, apart) + cost * np.abs(np.array([len(y) for y in part])[:, None] - sizes)
                least = least * (1 - 1e-9) - 1e-9
                d, seen, far = np.full(least.shape, math.inf), np.zeros(least.shape, bool), np.full((len(part), 1), math.inf)
                # the likeliest first, then ever more of those that could be as near, at last all
                for most in (4 * k, 64 * k, len(xs)):
                    pick = least <= far
                    if most < len(xs):
                        first = np.argpartition(least, most - 1, axis=1)[:, :most]
                        np.put_along_axis(likely := np.zeros_like(pick), first, True, 1)
                        pick &= likely
                    r, c = np.nonzero(pick & ~seen)
                    d[r, c] = move_split_merge_pairs(part, xs, r, c, cost)
                    seen[r, c] = True
                    near = np.argpartition(d, min(k, len(xs)) - 1, axis=1)[:, :k]
                    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
                    enough = np.cumsum(many[near], axis=1) >= k
                    far = np.where(enough[:, -1:], np.take_along_axis(d, np.take_along_axis(near, enough.argmax(1)[:, None], 1), 1), math.inf)
                for r, y in enumerate(part):
                    close = [(float(d[r, c]), i) for c in np.nonzero(seen[r] & (d[r] <= far[r]))[0].tolist() for i in ids[c]]
                    rows += [(y, i, dist) for dist, i in sorted(close)[:k]]
        return pd.DataFrame(rows, columns=["v", "id", "distance"])

    ship(series.sparkSession)
    found = both.groupBy("b", "qb").applyInPandas(look, f"v array<double>, id {kind}, distance double")
    best = cuts.cut(top_per_group(found, ["v"], [F.col("distance"), F.col("id")], k).unionByName(same.select("v", F.explode("ids").alias("id"), F.lit(0.0).alias("distance"))))
    return q.select(F.col("id").alias("probe"), "v").join(best, "v").select("probe", "id", "distance")


def trend_of(values: list[float], tolerance: float = 0.1) -> str:
    """``rising``, ``falling``, ``flat`` or ``volatile`` by the slope of the line through a series."""
    x = np.asarray(values, float)
    if len(x) < 2:
        return "flat"
    t = np.arange(len(x))
    slope = np.polyfit(t, x, 1)[0]
    spread = x.std()
    if spread < 1e-12 or abs(slope) * len(x) < tolerance * max(abs(x.mean()), 1e-12):
        return "flat" if spread < max(abs(x.mean()), 1e-12) else "volatile"
    return "rising" if slope > 0 else "falling"


def fuzzy_silhouette(x: np.ndarray, c: np.ndarray, m: float = 2.0, alpha: float = 1.0) -> float:
    """Mean silhouette over a bounded sample, weighted by how much the two best memberships differ."""
    u = _memberships(x, c, m)
    top = np.sort(u, axis=1)
    weight = (top[:, -1] - top[:, -2]) ** alpha if u.shape[1] > 1 else np.ones(len(x))
    label = u.argmax(1)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1), 0))
    s = np.zeros(len(x))
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() < 2:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min((d[i, label == k].mean() for k in np.unique(label) if k != label[i]), default=0.0)
        s[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float((weight * s).sum() / max(weight.sum(), 1e-12))


def poincare_embedding(edges: list[tuple], dim: int = 2, epochs: int = 100, rate: float = 0.1, negatives: int = 5, seed: int = 42) -> dict:
    """Points of the Poincaré ball for the nodes of a bounded is-a hierarchy of (child, parent): ``{node: vector}``.

    Riemannian gradient descent on the log-likelihood of each link against random nodes; links become near,
    general nodes lie towards the centre.
    """
    nodes = sorted({n for e in edges for n in e})
    at = {n: i for i, n in enumerate(nodes)}
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1e-3, 1e-3, (len(nodes), dim))
    pairs = np.array([(at[a], at[b]) for a, b in edges])

    def distance_and_grad(u: np.ndarray, v: np.ndarray):
        alpha, beta = 1 - u @ u, 1 - (v * v).sum(1)
        diff = ((u - v) ** 2).sum(1)
        gamma = 1 + 2 * diff / (alpha * beta)
        root = np.sqrt(np.maximum(gamma * gamma - 1, 1e-12))
        grad = 4 / (beta * root)[:, None] * ((((v * v).sum(1) - 2 * v @ u + 1) / alpha**2)[:, None] * u - v / alpha)
        return np.arccosh(np.maximum(gamma, 1 + 1e-12)), grad

    for epoch in range(epochs):
        step = rate * (0.1 if epoch < epochs // 10 else 1.0)
        for i in rng.permutation(len(pairs)):
            a, b = pairs[i]
            others = np.concatenate([[b], rng.integers(len(nodes), size=negatives)])
            d, g = distance_and_grad(p[a], p[others])
            w = np.exp(-d)
            w /= w.sum()
            w[0] -= 1
            move = -(w[:, None] * g).sum(0)
            p[a] -= step * ((1 - p[a] @ p[a]) ** 2 / 4) * move
            back, gb = distance_and_grad(p[b], p[[a]])
            p[b] -= step * ((1 - p[b] @ p[b]) ** 2 / 4) * -w[0] * gb[0]
            for k in (a, b):
                n = np.linalg.norm(p[k])
                if n >= 1:
                    p[k] *= (1 - 1e-5) / n
    return {n: p[i].tolist() for n, i in at.items()}
