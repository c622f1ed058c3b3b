"""Graph algorithms that need the whole graph of one project in a worker.

They run per group with ``applyInPandas``: one task holds the graph of one project, never that of all.
Edges beyond :data:`MOST_EDGES` in a group raise, instead of filling a worker.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MOST_EDGES = 5_000_000


def per_group(edges: DataFrame, group: str, func: Callable, schema: str) -> DataFrame:
    """Apply ``func(nodes, pairs)`` to every group's edges: sorted node ids and an array of index pairs.

    ``func`` yields rows without the group; null ends are dropped, parallel edges kept.
    """
    ship(edges.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_EDGES:
            raise ValueError(f"group {pdf['g'].iloc[0]!r} has more than {MOST_EDGES} edges")
        nodes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
        pairs = np.stack([np.searchsorted(nodes, pdf["src"].to_numpy()), np.searchsorted(nodes, pdf["dst"].to_numpy())], axis=1)
        out = pd.DataFrame(list(func(nodes, pairs)), columns=names)
        # the group's column keeps its type, also where there are no rows
        out.insert(0, group, pdf["g"].iloc[:1].repeat(len(out)).to_numpy() if len(out) else pdf["g"].iloc[:0].to_numpy(dtype=object))
        return out.astype(object) if not len(out) else out

    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(group).alias("g"), "src", "dst")
    kind = edges.schema[group].dataType.simpleString()
    return e.groupBy("g").applyInPandas(run, f"{group} {kind}, {schema}")


def per_sources(edges: DataFrame, group: str, func: Callable, schema: str, key: list[str], value: str, block: int = 256, most_blocks: int = 16) -> DataFrame:
    """As :func:`per_group` for sums over source nodes: each task holds a group's edges and takes one block of its sources.

    A group's edges are moved once for each of its blocks, of which there are at most ``most_blocks``.

    ``func(nodes, pairs, sources)`` yields rows of ``key`` and ``value`` for the given sources (indices);
    the values are summed over the blocks.
    """
    ship(edges.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(group).alias("g"), "src", "dst")
    ends = e.select("g", F.col("src").alias("v")).unionByName(e.select("g", F.col("dst").alias("v")))
    size = F.greatest(F.lit(block), F.ceil(F.col("n") / most_blocks)).cast("int")
    blocks = ends.groupBy("g").agg(F.countDistinct("v").alias("n")).select("g", size.alias("size"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / size) - 1).cast("int"))).alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_EDGES:
            raise ValueError(f"group {pdf['g'].iloc[0]!r} has more than {MOST_EDGES} edges")
        nodes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
        pairs = np.stack([np.searchsorted(nodes, pdf["src"].to_numpy()), np.searchsorted(nodes, pdf["dst"].to_numpy())], axis=1)
        b, size = int(pdf["b"].iloc[0]), int(pdf["size"].iloc[0])
        out = pd.DataFrame(list(func(nodes, pairs, range(b * size, min(len(nodes), (b + 1) * size)))), columns=names)
        out.insert(0, group, pdf["g"].iloc[:1].repeat(len(out)).to_numpy() if len(out) else pdf["g"].iloc[:0].to_numpy(dtype=object))
        return out.astype(object) if not len(out) else out

    kind = edges.schema[group].dataType.simpleString()
    parts = e.join(blocks.withColumnRenamed("g", "bg"), F.col("g").eqNullSafe(F.col("bg"))).drop("bg").groupBy("g", "b").applyInPandas(run, f"{group} {kind}, {schema}")
    return parts.groupBy(group, *key).agg(F.sum(value).alias(value))


def _neighbours(n: int, pairs: np.ndarray, directed: bool) -> list[list[int]]:
    adj: list[set[int]] = [set() for _ in range(n)]
    for a, b in pairs.tolist():
        if a != b:
            adj[a].add(b)
            if not directed:
                adj[b].add(a)
    return [sorted(x) for x in adj]


def betweenness(nodes: np.ndarray, pairs: np.ndarray, sources=None):
    """(node, score): shortest paths from the sources (all nodes without) through each node over directed simple edges (Brandes).

    The work of a source follows the edges it reaches, not the nodes there are.
    """
    n = len(nodes)
    adj = _neighbours(n, pairs, True)
    score = [0.0] * n
    for s in range(n) if sources is None else sources:
        sigma, dist, preds, order = {s: 1.0}, {s: 0}, {s: []}, [s]
        for v in order:
            far, ways = dist[v] + 1, sigma[v]
            for w in adj[v]:
                if w not in dist:
                    dist[w], sigma[w], preds[w] = far, ways, [v]
                    order.append(w)
                elif dist[w] == far:
                    sigma[w] += ways
                    preds[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            share = (1 + delta[w]) / sigma[w]
            for v in preds[w]:
                delta[v] += sigma[v] * share
            score[w] += delta[w]
    return zip(nodes.tolist(), score)


def louvain(nodes: np.ndarray, pairs: np.ndarray, passes: int = 50, resolution: float = 1.0):
    """(node, community): local moving by modularity gain over undirected summed weights, then aggregation.

    Nodes are visited in order of id and move to the neighbouring community of the greatest gain, ties to the smaller.
    """
    label = np.arange(len(nodes))
    weights: dict[tuple[int, int], float] = {}
    for a, b in pairs.tolist():
        key = (min(a, b), max(a, b))
        weights[key] = weights.get(key, 0.0) + 1.0
    total = sum(weights.values()) or 1.0
    while True:
        ids = np.unique(label)
        at = {c: i for i, c in enumerate(ids.tolist())}
        adj: list[dict[int, float]] = [{} for _ in ids]
        deg = np.zeros(len(ids))
        for (a, b), w in weights.items():
            x, y = at[label[a]], at[label[b]]
            deg[x] += w
            deg[y] += w
            if x != y:
                adj[x][y] = adj[x].get(y, 0.0) + w
                adj[y][x] = adj[y].get(x, 0.0) + w
        comm, mass, moved_any = np.arange(len(ids)), deg.copy(), False
        for _ in range(passes):
            moved = False
            for v in range(len(ids)):
                links: dict[int, float] = {}
                for u, w in adj[v].items():
                    links[comm[u]] = links.get(comm[u], 0.0) + w
                old = comm[v]
                mass[old] -= deg[v]
                best, gain = old, links.get(old, 0.0) - resolution * deg[v] * mass[old] / (2 * total)
                for c in sorted(links):
                    g = links[c] - resolution * deg[v] * mass[c] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += deg[v]
                if best != old:
                    comm[v], moved, moved_any = best, True, True
            if not moved:
                break
        label = np.array([ids[comm[at[c]]] for c in label.tolist()])
        if not moved_any:
            break
    first: dict[int, int] = {}
    for i, c in enumerate(label.tolist()):
        first.setdefault(c, i)
    return [(nodes[i].item(), nodes[first[c]].item()) for i, c in enumerate(label.tolist())]


def articulation(nodes: np.ndarray, pairs: np.ndarray):
    """(kind, a, b): articulation points (b null) and bridges (a < b) of the undirected graph."""
    n = len(nodes)
    adj = _neighbours(n, pairs, False)
    disc, low, timer = [-1] * n, [0] * n, 0
    cut, out = set(), []
    for root in range(n):
        if disc[root] >= 0:
            continue
        stack, kids = [(root, -1, iter(adj[root]))], 0
        disc[root] = low[root] = timer
        timer += 1
        while stack:
            v, parent, it = stack[-1]
            for w in it:
                if disc[w] < 0:
                    disc[w] = low[w] = timer
                    timer += 1
                    kids += v == root
                    stack.append((w, v, iter(adj[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], disc[w])
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > disc[parent]:
                        a, b = sorted((nodes[parent].item(), nodes[v].item()))
                        out.append(("bridge", a, b))
                    if parent != root and low[v] >= disc[parent]:
                        cut.add(parent)
        if kids > 1:
            cut.add(root)
    return [("articulation", nodes[i].item(), None) for i in sorted(cut)] + sorted(out)


def dominators(nodes: np.ndarray, pairs: np.ndarray):
    """(node, dominator): immediate dominators from a virtual entry to all nodes without an incoming edge
    (null where that entry dominates); nodes it cannot reach are left out."""
    n = len(nodes)
    entered = set(pairs[:, 1].tolist())
    entry = np.array([(n, i) for i in range(n) if i not in entered], dtype=int).reshape(-1, 2)
    adj = _neighbours(n + 1, np.concatenate([pairs, entry]), True)
    order, seen = [], {n}
    stack = [(n, iter(adj[n]))]
    while stack:
        v, it = stack[-1]
        for w in it:
            if w not in seen:
                seen.add(w)
                stack.append((w, iter(adj[w])))
                break
        else:
            order.append(v)
            stack.pop()
    rank = {v: i for i, v in enumerate(order)}
    preds: dict[int, list[int]] = {}
    for v in order:
        for w in adj[v]:
            preds.setdefault(w, []).append(v)
    idom = {n: n}
    changed = True
    while changed:
        changed = False
        for v in reversed(order[:-1]):
            new = None
            for p in preds.get(v, []):
                if p in idom:
                    if new is None:
                        new = p
                    else:
                        a, b = p, new
                        while a != b:
                            while rank[a] < rank[b]:
                                a = idom[a]
                            while rank[b] < rank[a]:
                                b = idom[b]
                        new = a
            if idom.get(v) != new:
                idom[v], changed = new, True
    return [(nodes[v].item(), None if idom[v] == n else nodes[idom[v]].item()) for v in sorted(seen - {n})]


def spectral(nodes: np.ndarray, pairs: np.ndarray, dense: int = 1024):
    """(nodes, lambda2): the algebraic connectivity, second smallest Laplacian eigenvalue (0 below two nodes and for several components).

    Beyond ``dense`` nodes no matrix is made: the value is the inverse of the largest eigenvalue of the
    Laplacian's pseudo-inverse, whose products are solved by conjugate gradients.
    """
    n = len(nodes)
    src, dst = _undirected(n, pairs)
    if n < 2 or _components(n, src, dst).any():
        return [(n, 0.0)]
    deg = np.bincount(src, minlength=n).astype(float)
    if n <= dense:
        lap = np.diag(deg)
        lap[src, dst] = -1
        return [(n, float(max(0.0, np.linalg.eigvalsh(lap)[1])))]

    def solve(b: np.ndarray) -> np.ndarray:
        b = b - b.mean()
        x, r = np.zeros(n), b.copy()
        z = r / deg
        p, rz, enough = z.copy(), float(r @ z), 1e-13 * float(np.linalg.norm(b))
        for _ in range(20 * n):
            if np.linalg.norm(r) <= enough:
                break
            ap = deg * p - np.bincount(src, weights=p[dst], minlength=n)
            step = rz / float(p @ ap)
            x += step * p
            r -= step * ap
            r -= r.mean()
            z = r / deg
            rz, old = float(r @ z), rz
            p = z + rz / old * p
        return x - x.mean()

    return [(n, 1 / _largest_eigenvalue(solve, n))]


def min_cut(nodes: np.ndarray, pairs: np.ndarray):
    """(nodes, weight): the global minimum cut of the undirected weighted graph, 0 below two nodes and for several components.

    Nodes are scanned by the weight that ties them to those before (maximum adjacency, as Stoer-Wagner); all edges
    whose ends such a scan shows to be connected by at least the best cut so far are contracted at once
    (Nagamochi, Ono and Ibaraki), so few scans are needed, each linear but for the queue.
    """
    n = len(nodes)
    if n < 2:
        return [(n, 0.0)]
    adj: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b in pairs.tolist():
        if a != b:
            adj[a][b] = adj[a].get(b, 0) + 1
            adj[b][a] = adj[b].get(a, 0) + 1
    best = min(sum(x.values()) for x in adj)
    while len(adj) > 1 and best:
        m = len(adj)
        root, tie, done = list(range(m)), [0] * m, [False] * m

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        queue, cut = [(0, 0)], 0
        for k in range(m):
            while queue and done[queue[0][1]]:
                heappop(queue)
            if not queue:
                # the rest cannot be reached
                return [(n, 0.0)]
            v = heappop(queue)[1]
            done[v] = True
            # the weight between the scanned nodes and the rest
            cut += sum(adj[v].values()) - 2 * tie[v]
            if k < m - 1:
                best = min(best, cut)
            for u, w in adj[v].items():
                if not done[u]:
                    tie[u] += w
                    if tie[u] >= best:
                        x, y = find(v), find(u)
                        root[max(x, y)] = min(x, y)
                    heappush(queue, (-tie[u], u))
        heads = {r: i for i, r in enumerate(sorted({find(v) for v in range(m)}))}
        merged: list[dict[int, int]] = [{} for _ in heads]
        for v in range(m):
            a = heads[find(v)]
            for u, w in adj[v].items():
                b = heads[find(u)]
                if a != b:
                    merged[a][b] = merged[a].get(b, 0) + w
        adj = merged
        if len(adj) > 1:
            best = min(best, min(sum(x.values()) for x in adj))
    return [(n, float(best))]


def k_truss(nodes: np.ndarray, pairs: np.ndarray):
    """(a, b, truss): the greatest k such that the edge is in a subgraph where every edge has k - 2 triangles."""
    adj = [set(x) for x in _neighbours(len(nodes), pairs, False)]
    support = {(a, b): len(adj[a] & adj[b]) for a in range(len(nodes)) for b in adj[a] if a < b}
    out, k = [], 2
    while support:
        low = [e for e, s in support.items() if s <= k - 2]
        if not low:
            k += 1
            continue
        for a, b in sorted(low):
            if (a, b) not in support:
                continue
            del support[a, b]
            out.append((nodes[a].item(), nodes[b].item(), k))
            for c in adj[a] & adj[b]:
                for e in ((min(a, c), max(a, c)), (min(b, c), max(b, c))):
                    if e in support:
                        support[e] -= 1
            adj[a].discard(b)
            adj[b].discard(a)
    return out


def _undirected(n: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of the undirected simple edges, sorted: starts and ends."""
    p = pairs[pairs[:, 0] != pairs[:, 1]].astype(np.int64)
    key = np.unique(np.concatenate([p[:, 0] * n + p[:, 1], p[:, 1] * n + p[:, 0]]))
    return key // max(n, 1), key % max(n, 1)


def constraint(nodes: np.ndarray, pairs: np.ndarray, chunk: int = 1 << 20):
    """(node, constraint): Burt's constraint over the undirected graph; nodes without neighbours have 0.

    A neighbour j of i counts ``((1 + sum over common neighbours q of 1 / d(q)) / d(i)) ** 2``.  Common neighbours are
    found as triangles, whose edges point from the smaller degree, in chunks of wedges; memory follows the edges.
    """
    n = len(nodes)
    src, dst = _undirected(n, pairs)
    deg = np.bincount(src, minlength=n)
    order = np.empty(n, np.int64)
    order[np.lexsort((np.arange(n), deg))] = np.arange(n)
    out = order[src] < order[dst]
    u, v = src[out], dst[out]
    key, directed = src * n + dst, u * n + v
    first = np.searchsorted(u, np.arange(n + 1))
    # an edge u -> v meets the edges that follow it at u
    follow = first[u + 1] - np.arange(len(u)) - 1
    before = np.concatenate([[0], np.cumsum(follow)])
    common = np.zeros(len(key))
    lo = 0
    while lo < len(u):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + chunk, "right")) - 1)
        one = np.repeat(np.arange(lo, hi), follow[lo:hi])
        two = one + 1 + np.arange(len(one)) - (before[one] - before[lo])
        a, b, c = u[one], v[one], v[two]
        x, y = np.where(order[b] < order[c], b, c), np.where(order[b] < order[c], c, b)
        at = np.searchsorted(directed, x * n + y)
        hit = (at < len(directed)) & (directed[np.minimum(at, len(directed) - 1)] == x * n + y)
        a, b, c = a[hit], b[hit], c[hit]
        for p, q, other in ((a, b, c), (a, c, b), (b, c, a)):
            np.add.at(common, np.searchsorted(key, p * n + q), 1 / deg[other])
            np.add.at(common, np.searchsorted(key, q * n + p), 1 / deg[other])
        lo = hi
    share = np.bincount(src, weights=((1 + common) / deg[src]) ** 2, minlength=n) if len(key) else np.zeros(n)
    return zip(nodes.tolist(), share.tolist())


def assortativity(nodes: np.ndarray, pairs: np.ndarray):
    """(edges, r): correlation of the degrees at both ends of the undirected edges; null if it is undefined."""
    adj = _neighbours(len(nodes), pairs, False)
    x = [(len(adj[a]), len(adj[b])) for a in range(len(nodes)) for b in adj[a]]
    if not x:
        return [(0, None)]
    a = np.array(x, float)
    if a[:, 0].std() == 0:
        return [(len(x) // 2, None)]
    return [(len(x) // 2, float(np.corrcoef(a[:, 0], a[:, 1])[0, 1]))]


def join_heads(label: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Labels (each a node's number) after the nodes ``at`` learned of the smaller labels ``new``: their heads learn of them too, and ways to heads are made short."""
    out = label.copy()
    np.minimum.at(out, at, new)
    np.minimum.at(out, label[at], new)
    while True:
        shorter = out[out]
        if (shorter == out).all():
            return out
        out = shorter


def _components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of every node's component; the edges are there in both directions."""
    label = np.arange(n)
    while True:
        less = label[dst] < label[src]
        if not less.any():
            return label
        label = join_heads(label, src[less], label[dst[less]])


def ranks_within(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node's place in its component and the component's size."""
    order = np.argsort(label, kind="stable")
    _, first, inverse, count = np.unique(label[order], return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(label), np.int64)
    size = np.empty(len(label), np.int64)
    rank[order] = np.arange(len(label)) - first[inverse]
    size[order] = count[inverse]
    return rank, size


#: Nodes with more neighbours than this are searched one at a time, the others one neighbour of many nodes at a time.
_MANY_NEIGHBOURS = 256


def _neighbour_bits(front: np.ndarray, first: np.ndarray, dst: np.ndarray, here: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The bits of ``want`` (a row for each of the nodes ``here``) that a neighbour has in ``front``."""
    many = first[here + 1] - first[here]
    out = np.zeros_like(want)
    few = np.nonzero(many <= _MANY_NEIGHBOURS)[0]
    few = few[np.argsort(-many[few], kind="stable")]
    # neighbour k of all nodes that have so many; nodes with all their bits are left out now and then
    got, deg, begin, k = np.zeros((len(few), want.shape[1]), want.dtype), many[few], first[here[few]], 0
    buf = np.empty_like(got)
    while len(few):
        for k in range(k, min(2 * k + 2, int(deg[0]))):
            m = int(np.searchsorted(-deg, -k - 1, "right"))
            np.take(front, dst[begin[:m] + k], axis=0, out=buf[:m], mode="clip")
            np.bitwise_or(got[:m], buf[:m], out=got[:m])
        k += 1
        on = (deg > k) & ((want[few] & ~got) != 0).any(1)
        out[few[~on]] = got[~on] & want[few[~on]]
        few, got, deg, begin = few[on], got[on], deg[on], begin[on]
    for i in np.nonzero(many > _MANY_NEIGHBOURS)[0].tolist():
        for lo in range(first[here[i]], first[here[i] + 1], (1 << 21) // want.shape[1]):
            out[i] |= np.bitwise_or.reduce(front[dst[lo : min(lo + (1 << 21) // want.shape[1], first[here[i] + 1])]], axis=0)
        out[i] &= want[i]
    return out


def hop_counts(first: np.ndarray, dst: np.ndarray, rank: np.ndarray, size: np.ndarray, lo: int, hi: int, most_hops: int | None = None):
    """(hops, nodes, count): how many nodes of places ``lo`` to ``hi - 1`` in its component each node has at each distance from 1 on.

    All searches go on at once, one bit each; nodes of one place in different components share a bit.  The neighbours
    of node ``i`` are ``dst[first[i]:first[i + 1]]``.
    """
    n = len(rank)
    bit = np.nonzero((rank >= lo) & (rank < hi))[0]
    words = max(1, -(-(min(hi, int(size.max(initial=0))) - lo) // 64))
    front = np.zeros((n, words), np.uint64)
    front[bit, (rank[bit] - lo) // 64] = np.uint64(1) << ((rank[bit] - lo) % 64).astype(np.uint64)
    left = np.clip(size - lo, 0, hi - lo)
    # the bits that a node's search has yet to meet
    each = np.clip(left[:, None] - 64 * np.arange(words), 0, 64).astype(np.uint64)
    want = np.where(each == 64, ~np.uint64(0), (np.uint64(1) << (each % np.uint64(64))) - np.uint64(1)) & ~front
    del each
    left[bit] -= 1
    h = 0
    while most_hops is None or h < most_hops:
        h += 1
        active = np.nonzero(left > 0)[0]
        if not len(active):
            return
        nxt, counts = np.zeros_like(front), np.zeros(len(active), np.int64)
        for i in range(0, len(active), step := max(1, (1 << 15) // words)):
            here = active[i : i + step]
            new = _neighbour_bits(front, first, dst, here, want[here])
            nxt[here] = new
            want[here] ^= new
            counts[i : i + step] = np.bitwise_count(new).sum(1, dtype=np.int64)
        if not counts.any():
            return
        left[active] -= counts
        front = nxt
        yield h, active, counts


def _largest_eigenvalue(times: Callable, n: int, steps: int = 80) -> float:
    """The largest eigenvalue of a symmetric matrix of which only products are known (Lanczos, restarted)."""
    q = np.ones(n) + 0.1 * np.random.default_rng(0).random(n)
    value = -np.inf
    for _ in range(50):
        basis, alpha, beta = [q / np.linalg.norm(q)], [], []
        for _ in range(min(steps, n)):
            w = times(basis[-1])
            alpha.append(float(w @ basis[-1]))
            for _ in range(2):
                for b in basis:
                    w = w - (b @ w) * b
            size = float(np.linalg.norm(w))
            if size < 1e-13 * max(1.0, abs(alpha[0])):
                break
            beta.append(size)
            basis.append(w / size)
        k = len(alpha)
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
        residual = beta[k - 1] * abs(vectors[-1, -1]) if len(beta) >= k else 0.0
        q = sum(c * b for c, b in zip(vectors[:, -1], basis))
        value = float(values[-1])
        if residual <= 1e-9 * abs(value) or k == n:
            break
    return value


def centralities(nodes: np.ndarray, pairs: np.ndarray, alpha: float = 0.1, iterations: int = 100, block: int = 1024):
    """(node, closeness, eigenvector, katz) over the undirected graph.

    Closeness is ``(r / (n - 1)) (r / S)`` with r nodes reached at a summed distance S; Katz iterates
    ``x = alpha A x + 1`` and is scaled to length 1, as the eigenvector is.
    """
    n = len(nodes)
    src, dst = _undirected(n, pairs)
    rank, size = ranks_within(_components(n, src, dst))
    first = np.searchsorted(src, np.arange(n + 1))
    reached, total = np.zeros(n), np.zeros(n)
    for lo in range(0, int(size.max(initial=0)), block):
        for h, at, count in hop_counts(first, dst, rank, size, lo, lo + block):
            reached[at] += count
            total[at] += h * count
    close = np.where(total > 0, reached / max(n - 1, 1) * reached / np.maximum(total, 1), 0.0)
    times = lambda x: np.bincount(src, weights=x[dst], minlength=n)
    eig, katz = np.ones(n) / max(1, n) ** 0.5, np.zeros(n)
    deg = np.bincount(src, minlength=n).astype(float)
    # no eigenvalue is larger than the mean degree of some edge's ends, so that mostly none is needed
    most = float(np.sqrt(deg[src] * deg[dst]).max(initial=1.0))
    limit = alpha if most * alpha <= 0.9 else min(alpha, 0.9 / max(1.0, _largest_eigenvalue(times, n)))
    for _ in range(iterations):
        nxt = times(eig) + eig
        eig = nxt / (np.linalg.norm(nxt) or 1.0)
        katz = limit * times(katz) + 1
    katz /= np.linalg.norm(katz) or 1.0
    return zip(nodes.tolist(), close.tolist(), eig.tolist(), katz.tolist())


def simple_cycles(nodes: np.ndarray, pairs: np.ndarray, most: int = 10_000):
    """(cycle, length): all simple directed cycles as texts ``a>b>c`` from their smallest node.

    For each smallest node only what lies on a cycle with it is searched, and a node is closed while no
    way from it leads back, so the time follows the number of cycles.  Raises if a group has more than
    ``most``; cycles are many where graphs are dense.
    """
    n = len(nodes)
    adj = _neighbours(n, pairs, True)
    back: list[list[int]] = [[] for _ in range(n)]
    for v, ws in enumerate(adj):
        for w in ws:
            back[w].append(v)
    out = [(str(nodes[a]), 1) for a in sorted({a for a, b in pairs.tolist() if a == b})]

    def reach(start: int, links: list[list[int]]) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            for w in links[todo.pop()]:
                if w > start and w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    for s in range(n):
        inside = reach(s, adj) & reach(s, back)
        if len(inside) < 2:
            continue
        path, closed, led_back = [s], {s}, [False]
        waiting: dict[int, set[int]] = {}
        ways = [iter([w for w in adj[s] if w in inside])]
        while ways:
            w = next(ways[-1], None)
            if w == s:
                out.append((">".join(str(nodes[i]) for i in path), len(path)))
                led_back[-1] = True
                if len(out) > most:
                    raise ValueError(f"more than {most} cycles")
            elif w is None:
                ways.pop()
                v, success = path.pop(), led_back.pop()
                if success:
                    todo = [v]
                    while todo:
                        u = todo.pop()
                        if u in closed:
                            closed.discard(u)
                            todo += waiting.pop(u, ())
                    if led_back:
                        led_back[-1] = True
                else:
                    for x in adj[v]:
                        if x in inside:
                            waiting.setdefault(x, set()).add(v)
            elif w not in closed:
                path.append(w)
                closed.add(w)
                led_back.append(False)
                ways.append(iter([x for x in adj[w] if x in inside]))
    return out


def edge_betweenness(nodes: np.ndarray, pairs: np.ndarray, sources=None):
    """(a, b, score): shortest paths from the sources (all nodes without) over each directed edge."""
    n = len(nodes)
    adj = _neighbours(n, pairs, True)
    score: dict[tuple[int, int], float] = {}
    for s in range(n) if sources is None else sources:
        order, preds = [], [[] for _ in range(n)]
        sigma, dist = np.zeros(n), np.full(n, -1)
        sigma[s], dist[s] = 1, 0
        q = deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = np.zeros(n)
        for w in reversed(order):
            for v in preds[w]:
                x = sigma[v] / sigma[w] * (1 + delta[w])
                score[v, w] = score.get((v, w), 0.0) + x
                delta[v] += x
    return [(nodes[a].item(), nodes[b].item(), x) for (a, b), x in sorted(score.items())]


def two_edge_components(nodes: np.ndarray, pairs: np.ndarray):
    """(node, component): components that stay connected if any one edge is cut, named by their smallest node."""
    index = {v: i for i, v in enumerate(nodes.tolist())}
    bridges = {(index[a], index[b]) for kind, a, b in articulation(nodes, pairs) if kind == "bridge"}
    keep = [(a, b) for a, b in pairs.tolist() if (min(a, b), max(a, b)) not in {(min(x), max(x)) for x in bridges}]
    root = list(range(len(nodes)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in keep:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(v, nodes[find(i)].item()) for i, v in enumerate(nodes.tolist())]


def attack(nodes: np.ndarray, pairs: np.ndarray, share: float = 0.2):
    """(removed, largest): size of the largest component as the nodes of the highest degree are taken away one by one."""
    adj = [set(x) for x in _neighbours(len(nodes), pairs, False)]
    live = set(range(len(nodes)))
    out = []
    for k in range(int(share * len(nodes)) + 1):
        seen: set[int] = set()
        largest = 0
        for s in live:
            if s not in seen:
                todo, size = [s], 0
                seen.add(s)
                while todo:
                    v = todo.pop()
                    size += 1
                    for w in adj[v]:
                        if w in live and w not in seen:
                            seen.add(w)
                            todo.append(w)
                largest = max(largest, size)
        out.append((k, largest))
        if live:
            live.remove(max(live, key=lambda v: (len(adj[v] & live), -v)))
    return out


def _strong_sets(adj: list[list[int]]) -> list[list[int]]:
    """The strongly connected sets (one pass, by lowest reachable number)."""
    n = len(adj)
    number, low, on, stack, out, timer = [-1] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if number[root] >= 0:
            continue
        ways = [(root, iter(adj[root]))]
        number[root] = low[root] = timer
        timer += 1
        stack.append(root)
        on[root] = True
        while ways:
            v, it = ways[-1]
            for w in it:
                if number[w] < 0:
                    number[w] = low[w] = timer
                    timer += 1
                    stack.append(w)
                    on[w] = True
                    ways.append((w, iter(adj[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], number[w])
            else:
                ways.pop()
                if ways:
                    low[ways[-1][0]] = min(low[ways[-1][0]], low[v])
                if low[v] == number[v]:
                    found = []
                    while not found or found[-1] != v:
                        found.append(stack.pop())
                        on[found[-1]] = False
                    out.append(found)
    return out


def core_periphery(nodes: np.ndarray, pairs: np.ndarray):
    """(node, role): ``core`` (largest strongly connected set), ``shared`` (reached from it), ``control`` (reaches it) or ``periphery``.

    Of sets of one size the one with the smallest node is the core.  Time and memory follow the edges.
    """
    n = len(nodes)
    if not n:
        return []
    adj = _neighbours(n, pairs, True)
    core = min(_strong_sets(adj), key=lambda c: (-len(c), min(c)))

    def reach(links: list[list[int]]) -> set[int]:
        seen, todo = set(core), list(core)
        while todo:
            for w in links[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    inside, after, before = set(core), reach(adj), reach(_neighbours(n, pairs[:, ::-1], True))
    role = ["core" if v in inside else "shared" if v in after else "control" if v in before else "periphery" for v in range(n)]
    return list(zip(nodes.tolist(), role))
