import random

from stratoloom.operators import graph as G
from stratoloom.operators import graph_local as L

E = "src long, dst long"


def as_map(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_components_on_random_graphs(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(25)] + [(None, 1), (7, 7)]
        root = {}

        def find(a):
            root.setdefault(a, a)
            while root[a] != a:
                a = root[a]
            return a

        for a, b in edges:
            if a is not None:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        want = {n: find(n) for n in list(root)}
        assert {r.id: r.component for r in G.connected_components(spark.createDataFrame(edges, E)).collect()} == want
    assert G.connected_components(spark.createDataFrame([], E)).count() == 0


def test_pagerank_sums_to_one_and_prefers_the_hub(spark):
    e = G.edge_list(spark.createDataFrame([(1, 2), (3, 2), (4, 2), (2, 1), (5, 4), (None, 2)], E))
    r = {x.id: x.rank for x in G.pagerank(e, iterations=50).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and max(r, key=r.get) == 2
    p = {x.id: x.rank for x in G.pagerank(e, iterations=50, seeds=[5]).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and p[3] == 0


def test_strong_components_closure_and_bfs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (4, 5), (6, 6)], E)
    assert {r.id: r.component for r in G.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    c = {(r.src, r.dst): r.hops for r in G.transitive_closure(e).collect()}
    assert c[(5, 3)] == 4 and c[(1, 1)] == 3 and (1, 4) not in c
    assert {r.id: r.hops for r in G.bfs(e, [5], 2).collect()} == {5: 0, 4: 1, 1: 2}
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], E)
    assert G.transitive_closure(chain).count() == 30 * 31 // 2


def test_core_triangles_motifs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 1)], E)
    assert {r.id: r.core for r in G.k_core(e).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1}
    assert {r.id: r.triangles for r in G.triangles(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    assert {r.motif: r.n for r in G.motif_census(e).collect()}["cycle"] == 1
    star = spark.createDataFrame([(0, i) for i in range(1, 6)], E)
    assert set(r.core for r in G.k_core(star).collect()) == {1}


def test_module_metrics_and_harmonic(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], E)
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id long, module string")
    got = as_map(G.module_metrics(e, m), "module")
    assert (got["a"].ce, got["b"].ca, got["a"].instability, got["c"].instability) == (1, 2, 1.0, 0.0)
    h = {r.id: r.harmonic for r in G.harmonic_centrality(spark.createDataFrame([(1, 2), (2, 3)], E)).collect()}
    assert h == {1: 0.75, 2: 1.0, 3: 0.75}


def test_local_algorithms(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 3, 4), ("h", 1, 2)], "p string, src long, dst long")
    run = lambda f, s: [r for r in L.per_group(e, "p", f, s).collect() if r.p == "g"]
    assert {(r.kind, r.a, r.b) for r in run(L.articulation, "kind string, a long, b long")} == {("articulation", 3, None), ("bridge", 3, 4)}
    assert run(L.min_cut, "nodes int, weight double")[0].weight == 1
    assert {(r.a, r.b): r.truss for r in run(L.k_truss, "a long, b long, truss int")} == {(1, 2): 3, (2, 3): 3, (1, 3): 3, (3, 4): 2}
    b = {r.id: r.score for r in run(L.betweenness, "id long, score double")}
    assert b[3] == 3 and b[4] == 0
    assert len(run(L.louvain, "id long, community long")) == 4
    assert abs(run(L.spectral, "nodes int, lambda2 double")[0].lambda2 - 1) < 1e-9


def test_dominators_of_a_pure_loop(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 1), ("h", 1, 2), ("h", 2, 3), ("h", 1, 3)], "p string, src long, dst long")
    got = {(r.p, r.id, r.dominator) for r in L.per_group(e, "p", L.dominators, "id long, dominator long").collect()}
    assert got == {("h", 1, None), ("h", 2, 1), ("h", 3, 1)}


def test_ranked_paths_are_pruned_by_flow(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 4, 0.5), (3, 4, 0.1), (4, 1, 1.0), (4, 5, -1.0), (2, 3, 0.1)], E + ", w double")
    seeds = spark.createDataFrame([(1, 1.0)], "id long, w double")
    found = [(tuple(r.path), r.hops, round(r.flow, 9), r["rank"]) for r in G.ranked_paths(e, seeds, 3, 0.2, 4).collect()]
    assert found == [((1, 3), 1, 0.9, 1), ((1, 2), 1, 0.5, 2), ((1, 2, 4), 2, 0.25, 3), ((1, 2, 4, 5), 3, 0.25, 4)]
    assert G.ranked_paths(e, seeds, 3, 0.2, 2).count() == 2


def test_html_strip_keeps_every_document(spark, tmp_path):
    from stratoloom.plans.text import html_strip_all

    rows = [(1, "a <b>c</b>"), (2, "x<!-- y -->z"), (3, "<script>q</script>a &amp; b"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.plain for r in html_strip_all(spark, str(tmp_path)).collect()} == {1: "a c", 2: "x z", 3: "a & b", 4: ""}
