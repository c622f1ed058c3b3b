import numpy as np

from stratoloom.operators import graph_local as L
from stratoloom.operators import vector_trees as W
from stratoloom.operators.graph import main_sequence


def test_summary_tree_holds_every_row_once(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((9, 8)), 40, axis=0) + 0.05 * rng.standard_normal((360, 8))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(1000 + i, [1.0] * 8) for i in range(50)] + [(None, [1.0] * 8), (2000, None), (0, [float(a) for a in x[0]])]
    nodes, leaves = W.summary_tree(spark.createDataFrame(rows, "id long, vec array<double>"), fanout=4, leaf_rows=60)
    n, placed = {r.node: r for r in nodes.collect()}, {r.id: r.node for r in leaves.collect()}
    assert len(placed) == 410 and leaves.count() == 410 and n["r"].size == 410 and n["r"].parent is None
    for r in n.values():
        below = [c for c in n.values() if c.parent == r.node]
        own = sum(v == r.node for v in placed.values())
        assert r.level == r.node.count(".") and (sum(c.size for c in below) == r.size and own == 0 if below else own == r.size)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    every = np.vstack([unit, np.full((50, 8), 8**-0.5)])
    assert np.allclose(n["r"].vec, every.mean(0))
    best = W.summary_search(nodes, [float(a) for a in x[0]], 3).collect()
    assert len(best) == 3 and placed[0].startswith(best[0].node) or best[0].node.startswith(placed[0])
    assert W.summary_tree(spark.createDataFrame([], "id long, vec array<double>"))[1].count() == 0


def test_merge_order_is_average_linkage(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((7, 5))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(50, [0.0] * 5), (51, None)], "id int, vec array<double>")
    got = W.merge_order(df)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = {i: [i] for i in range(7)}
    for step, a, b, dist, size in got:
        mean = {(p, q): d[np.ix_(groups[p], groups[q])].mean() for p in groups for q in groups if p < q}
        assert abs(mean[a, b] - dist) < 1e-9 and dist <= min(mean.values()) + 1e-9
        groups[a] += groups.pop(b)
        assert len(groups[a]) == size
    assert len(got) == 6 and set(W.cut_merges(range(7), got, 5.0).values()) == {0} and len(set(W.cut_merges(range(7), got, -1.0).values())) == 7
    assert W.merge_order(df.limit(0)) == []


def test_online_clusters_follow_the_stream(spark):
    df = lambda c: spark.createDataFrame([(i, [c + 0.01 * i, 1.0]) for i in range(20)], "id int, vec array<double>")
    model = W.OnlineClusters(np.array([[0.0, 1.0], [10.0, 1.0]]), keep=0.5)
    for c in (1.0, 9.0, 1.0, 9.0):
        model.update(df(c))
    # fuzzy centres feel the rows of the other cluster a little
    assert abs(model.centres[0][0] - 1.1) < 1.2 and abs(model.centres[1][0] - 9.1) < 1.2
    before = model.centres.copy()
    assert np.allclose(model.update(df(1.0).limit(0)), before)


def test_sums_over_sources_are_those_of_one_task(spark):
    rng = np.random.default_rng(6)
    e = [("g", int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2))] + [("h", 1, 2), ("h", 2, 3), (None, 4, 5), ("h", None, 1)]
    df = spark.createDataFrame(e, "g string, src long, dst long")
    for func, schema, key in ((L.betweenness, "id long, score double", ["id"]), (L.edge_betweenness, "a long, b long, score double", ["a", "b"])):
        one = {tuple(r)[:-1]: r.score for r in L.per_group(df, "g", func, schema).collect()}
        many = {tuple(r)[:-1]: r.score for r in L.per_sources(df, "g", func, schema, key, "score", block=4).collect()}
        assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_distance_from_the_balance(spark):
    m = spark.createDataFrame([("a", 1, 1, 0.5), ("b", 0, 2, 1.0), ("c", 0, 0, 0.0)], "module string, ca long, ce long, instability double")
    t = spark.createDataFrame([("a", 1, 2), ("c", 0, 0)], "module string, abstract long, total long")
    assert {(r.module, r.abstractness, r.distance) for r in main_sequence(m, t).collect()} == {("a", 0.5, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0)}
