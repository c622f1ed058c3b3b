"""Graph operators at sizes where work with the square of the nodes does not end, and against the plain definitions."""

import time

import numpy as np

from stratoloom.operators import graph as G
from stratoloom.operators import graph_blocks as K
from stratoloom.operators import graph_local as L
from stratoloom.operators import learning as M
from stratoloom.plans import learning


def random_pairs(rng, n, m):
    """Nodes 0..n-1 that have an edge, as an operator gets them: sorted ids and pairs of indices."""
    e = rng.integers(0, n, (m, 2))
    nodes = np.unique(e)
    return nodes, np.searchsorted(nodes, e)


def test_core_periphery_by_reach_and_at_size():
    rng = np.random.default_rng(1)
    for _ in range(40):
        nodes, pairs = random_pairs(rng, int(rng.integers(2, 25)), int(rng.integers(1, 40)))
        reach = np.eye(len(nodes), dtype=bool)
        reach[pairs[:, 0], pairs[:, 1]] = True
        for _ in nodes:
            reach |= reach @ reach
        sizes = (reach & reach.T).sum(1)
        lead = int(np.argmax(sizes))
        want = ["core" if reach[lead, v] and reach[v, lead] else "shared" if reach[lead, v] else "control" if reach[v, lead] else "periphery" for v in range(len(nodes))]
        assert L.core_periphery(nodes, pairs) == list(zip(nodes.tolist(), want))
    nodes, pairs = random_pairs(rng, 30_000, 33_000)
    began = time.process_time()
    roles = dict(L.core_periphery(nodes, pairs))
    assert len(roles) == len(nodes) and time.process_time() - began < 20


def test_min_cut_by_all_cuts_and_at_size():
    rng = np.random.default_rng(2)
    for _ in range(60):
        nodes, pairs = random_pairs(rng, int(rng.integers(2, 9)), int(rng.integers(1, 30)))
        n = len(nodes)
        sides = [[m >> v & 1 for v in range(n)] for m in range(1, 2 ** (n - 1))]
        want = min((sum(s[a] != s[b] for a, b in pairs.tolist()) for s in sides), default=0)
        assert L.min_cut(nodes, pairs) == [(n, float(want))]
    # two dense halves of 1,500 nodes, joined by three edges
    half = np.concatenate([np.stack([np.arange(1500), (np.arange(1500) + k) % 1500], 1) for k in (1, 2, 5, 11)])
    pairs = np.concatenate([half, half + 1500, [[0, 1500], [700, 2200], [9, 1510]]])
    began = time.process_time()
    assert L.min_cut(np.arange(3000), pairs) == [(3000, 3.0)] and time.process_time() - began < 20


def test_series_neighbours_of_equal_and_many_series(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(0, 4, rng.integers(0, 6))]) for i in range(150)] + [(200, None), (None, [1.0])]
    s = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.probe, r.distance, r.id) for r in M.series_neighbours(s, s.where("id % 10 = 0"), "id", "v", 4, block=16, probe_block=4).collect())
    known = [(i, np.array(v)) for i, v in rows[:150]]
    want = [(p, d, i) for p, y in known[::10] for d, i in sorted((M.move_split_merge(y, x), i) for i, x in known)[:4]]
    assert got == sorted(want)
    a, b = rng.integers(0, 4, (200, 9)).astype(float), rng.integers(0, 4, (3000, 8)).astype(float)
    began = time.process_time()
    d = M.move_split_merge_all(a, b)
    assert time.process_time() - began < 20 and d[7, 11] == M.move_split_merge(a[7], b[11])


def test_msm_knn_asks_for_all_customers(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey", "o_orderdate").collect()
    counts = {}
    for r in orders:
        t = (r.o_orderdate.year, (r.o_orderdate.month - 1) // 3)
        counts.setdefault(r.o_custkey, {}).setdefault(t, 0)
        counts[r.o_custkey][t] += 1
    series = [(c, np.array([float(v[t]) for t in sorted(v)])) for c, v in sorted(counts.items())]
    got = {}
    for r in learning.msm_knn(spark, data).collect():
        got.setdefault(r.probe, []).append((r.distance, r.id))
    assert len(series) > 100 and got.keys() == counts.keys()
    for c, y in series[::15]:
        want = sorted((M.move_split_merge(y, x), i) for i, x in series)[:5]
        assert np.allclose([d for d, _ in sorted(got[c])], [d for d, _ in want]) and len({i for _, i in got[c]}) == 5


def test_series_that_are_left_out_are_further_away():
    rng = np.random.default_rng(11)
    vs = [rng.integers(0, 5, rng.integers(1, 9)).astype(float) for _ in range(60)]
    i, j = (x.ravel() for x in np.indices((60, 60)))
    d = M.move_split_merge_pairs(vs, vs, i, j)
    sizes, wide = np.array([len(v) for v in vs]), M._shape_of(vs)
    assert np.allclose(d, [M.move_split_merge(vs[a], vs[b]) for a, b in zip(i, j)])
    assert (d >= np.abs(wide[i] - wide[j]).max(1) + 0.1 * np.abs(sizes[i] - sizes[j]) - 1e-9).all()


def test_betweenness_of_many_nodes_that_reach_few():
    rng = np.random.default_rng(4)
    nodes, pairs = random_pairs(rng, 20, 45)
    # by the definition, from the numbers of shortest paths
    n = len(nodes)
    dist, ways = np.full((n, n), np.inf), np.eye(n)
    np.fill_diagonal(dist, 0)
    a = np.zeros((n, n))
    a[pairs[:, 0], pairs[:, 1]] = 1
    np.fill_diagonal(a, 0)
    step = np.eye(n)
    for h in range(1, n):
        step = step @ a
        new = (step > 0) & np.isinf(dist)
        dist[new], ways[new] = h, step[new]
    want = [sum(ways[s, v] * ways[v, t] / ways[s, t] for s in range(n) for t in range(n) if len({s, v, t}) == 3 and np.isfinite(dist[s, t]) and dist[s, v] + dist[v, t] == dist[s, t]) for v in range(n)]
    assert np.allclose([x for _, x in L.betweenness(nodes, pairs)], want)
    nodes, pairs = random_pairs(rng, 40_000, 20_000)
    began = time.process_time()
    assert len(list(L.betweenness(nodes, pairs))) == len(nodes) and time.process_time() - began < 20


def test_constraint_by_matrices_and_at_size():
    rng = np.random.default_rng(5)
    for n, m in ((3, 1), (25, 60), (12, 90), (4, 3)):
        nodes, pairs = random_pairs(rng, n, m)
        a = np.zeros((len(nodes), len(nodes)))
        a[pairs[:, 0], pairs[:, 1]] = a[pairs[:, 1], pairs[:, 0]] = 1
        np.fill_diagonal(a, 0)
        p = a / np.maximum(a.sum(1, keepdims=True), 1)
        want = ((p + p @ p) ** 2 * (p > 0)).sum(1)
        for chunk in (1, 7, 1 << 20):
            assert np.allclose([x for _, x in L.constraint(nodes, pairs, chunk)], want)
    assert list(L.constraint(np.array([5]), np.array([[0, 0]]))) == [(5, 0.0)]
    # a matrix of these nodes would take 80 GB
    nodes, pairs = random_pairs(rng, 100_000, 110_000)
    assert len(list(L.constraint(nodes, pairs))) == len(nodes)


def test_centralities_by_matrices_and_at_size():
    rng = np.random.default_rng(6)
    for n, m in ((2, 1), (30, 25), (40, 400), (90, 60)):
        nodes, pairs = random_pairs(rng, n, m)
        n = len(nodes)
        a = np.zeros((n, n))
        a[pairs[:, 0], pairs[:, 1]] = a[pairs[:, 1], pairs[:, 0]] = 1
        np.fill_diagonal(a, 0)
        dist, reach = np.zeros((n, n)), np.eye(n) > 0
        for h in range(1, n):
            new = (reach @ a > 0) & ~reach
            dist[new] = h
            reach |= new
        r, total = reach.sum(1) - 1, dist.sum(1)
        close = np.where(total > 0, r / max(n - 1, 1) * r / np.maximum(total, 1), 0)
        limit = min(0.1, 0.9 / max(1.0, np.abs(np.linalg.eigvalsh(a)).max()))
        eig, katz = np.ones(n) / n**0.5, np.zeros(n)
        for _ in range(100):
            eig = a @ eig + eig
            eig /= np.linalg.norm(eig)
            katz = limit * a @ katz + 1
        want = np.stack([close, eig, katz / np.linalg.norm(katz)], 1)
        for block in (5, 1024):
            assert np.allclose([x[1:] for x in L.centralities(nodes, pairs, block=block)], want, atol=1e-9)
    # a matrix of these nodes would take 7 GB
    nodes, pairs = random_pairs(rng, 30_000, 20_000)
    began = time.process_time()
    assert len(list(L.centralities(nodes, pairs))) == len(nodes) and time.process_time() - began < 60


def test_spectral_by_matrix_and_at_size():
    rng = np.random.default_rng(7)
    for n in (300, 40, 7):
        ring = np.stack([np.arange(n), (np.arange(n) + 1) % n], 1)
        pairs = np.concatenate([ring, rng.integers(0, n, (n // 4, 2))])
        exact, found = L.spectral(np.arange(n), pairs)[0][1], L.spectral(np.arange(n), pairs, dense=3)[0][1]
        assert abs(exact - found) < 1e-8 * exact and exact > 0
    assert abs(L.spectral(np.arange(4), np.array([[0, 1], [1, 2], [2, 3]]))[0][1] - (2 - 2**0.5)) < 1e-12
    assert L.spectral(np.arange(4), np.array([[0, 1], [2, 3]])) == [(4, 0.0)]
    # matrices of these nodes would take 72 GB and 0.1 GB
    nodes, pairs = random_pairs(rng, 100_000, 110_000)
    assert L.spectral(nodes, pairs) == [(len(nodes), 0.0)]
    n = 4_000
    pairs = np.concatenate([np.stack([np.arange(n), (np.arange(n) + 1) % n], 1), rng.integers(0, n, (2 * n, 2))])
    began = time.process_time()
    assert 0 < L.spectral(np.arange(n), pairs)[0][1] < 6 and time.process_time() - began < 60


def test_harmonic_of_all_nodes_as_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [tuple(map(int, e)) for e in np.concatenate([rng.integers(0, 60, (50, 2)), rng.integers(100, 130, (90, 2)) * 7, [[900 + i, 901 + i] for i in range(70)]])] + [(5, 5), (2000, 2000), (None, 3)]
    e = spark.createDataFrame(rows, "src long, dst long")
    for hops in (64, 3):
        with monkeypatch.context() as m:
            m.setattr(K, "_PACK_NODES", 40)
            got = {r.id: r.harmonic for r in G.harmonic_centrality(e, most_hops=hops).collect()}
            m.setattr(K, "MOST_NODES", 0)
            want = {r.id: r.harmonic for r in G.harmonic_centrality(e, most_hops=hops).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # all pairs of these nodes would be 100 million rows
    pairs = rng.integers(0, 10_000, (60_000, 2))
    h = G.harmonic_centrality(spark.createDataFrame([tuple(map(int, p)) for p in pairs], "src long, dst long")).toPandas()
    first, dst = (lambda s, d: (np.searchsorted(s, np.arange(10_001)), d))(*L._undirected(10_000, pairs))
    v = int(h["id"].iloc[17])
    dist, todo = {v: 0}, [v]
    for a in todo:
        for b in dst[first[a] : first[a + 1]].tolist():
            if b not in dist:
                dist[b] = dist[a] + 1
                todo.append(b)
    assert len(h) == len(np.unique(pairs)) and abs(h["harmonic"].iloc[17] - sum(1 / d for d in dist.values() if d) / (len(h) - 1)) < 1e-12


def test_harmonic_of_a_large_component_without_a_table_of_pairs(spark, monkeypatch):
    # one component with a hub of many neighbours and a tail
    rng = np.random.default_rng(10)
    pairs = np.concatenate([rng.integers(0, 700, (900, 2)), np.stack([np.full(400, 3), np.arange(400)], 1), np.stack([np.arange(699, 719), np.arange(700, 720)], 1), np.stack([np.arange(699), np.arange(1, 700)], 1)])
    src, dst = L._undirected(720, pairs)
    first = np.searchsorted(src, np.arange(721))
    want = []
    for v in range(720):
        dist, todo = {v: 0}, [v]
        for a in todo:
            for b in dst[first[a] : first[a + 1]].tolist():
                if b not in dist:
                    dist[b] = dist[a] + 1
                    todo.append(b)
        want.append(sum(1 / d for d in dist.values() if d) / 719)
    # limits of a worker, ranges of sources, blocks and rows of sums that this component goes beyond
    for name, value in (("MOST_LINKS", 500), ("BLOCK_LINKS", 300), ("_TASKS", 7), ("_SEARCH_WORDS", 720), ("_SUM_NODES", 100)):
        monkeypatch.setattr(K, name, value, raising=False)
    written = []
    monkeypatch.setattr(G.Cuts, "cut", lambda self, df, *by, f=G.Cuts.cut: written.append(df.columns) or f(self, df, *by))
    h = G.harmonic_centrality(spark.createDataFrame([tuple(map(int, p)) for p in pairs], "src int, dst int")).orderBy("id").toPandas()
    assert h["id"].tolist() == list(range(720)) and np.allclose(h["harmonic"], want, atol=1e-12, rtol=0)
    assert ["s", "v"] not in written and len(written) < 5


def test_cores_in_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    # degrees of all sizes, so that taking away by levels takes hundreds of rounds
    pairs = np.concatenate([(rng.random((3_000, 2)) ** 3 * 400).astype(int), [[500, 501], [501, 502], [600, 600]]])
    e = spark.createDataFrame([tuple(map(int, p)) for p in pairs] + [(None, 1), (700, None)], "src int, dst int")
    adj = {int(v): set() for v in np.unique(pairs)}
    for a, b in pairs.tolist():
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    want, left, k = {}, {v: len(x) for v, x in adj.items()}, 0
    while left:
        v = min(left, key=left.get)
        k = max(k, left.pop(v))
        want[v] = k
        for u in adj[v]:
            if u in left:
                left[u] -= 1
    cuts = []
    monkeypatch.setattr(G.Cuts, "cut", lambda self, df, f=G.Cuts.cut: cuts.append(0) or f(self, df))
    core = G.k_core(e)
    assert {r.id: r.core for r in core.collect()} == want and core.schema["id"].dataType.typeName() == "integer" and len(cuts) < 5
    monkeypatch.setattr(K, "MOST_NODES", 0)
    few = e.where("src > 300")
    by_levels = {r.id: r.core for r in G.k_core(few).collect()}
    monkeypatch.undo()
    assert {r.id: r.core for r in G.k_core(few).collect()} == by_levels
