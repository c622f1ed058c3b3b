import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoloom.functions import text as T
from stratoloom.operators import bitemporal as B
from stratoloom.operators import learning as M
from stratoloom.operators import stats as S
from stratoloom.operators import text as X
from stratoloom.operators import vectors as V


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, None, "b"), (5, [0.0, 0.0], "b")], "id long, vec array<double>, g string")
    assert [r.id for r in V.nearest_to(df, [1.0, 0.0], 2, "id", "vec").collect()] == [1, 2]
    got = {(r.q, r.rank): r.c for r in V.nearest_to_each(df, df, 1).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 2}
    assert {r.q for r in V.nearest_to_each(df, df, None, least=0.9).collect()} == {1, 2}
    assert {r.g: [round(x, 3) for x in r.centroid] for r in V.centroids(df.where("id < 4"), "g", "vec").collect()} == {"a": [0.95, 0.05], "b": [0.0, 1.0]}
    assert V.nearest_to_each(df.where("false"), df.where("false"), 1).count() == 0


def test_lof_marks_the_outlier(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.05, (40, 3)) + [1, 1, 1]
    x[0] = [1, -1, 0.2]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    lof = {r.id: r.lof for r in V.local_outlier_factors(V.nearest_to_each(df, df, 8), 8).collect()}
    assert max(lof, key=lof.get) == 0 and np.median(list(lof.values())) < 1.5


def test_simhash_is_complete_within_the_bands(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.001]), (4, [-1.0, 0.0, 5.0])], "id long, vec array<double>")
    pairs = {(r.id_a, r.id_b) for r in V.simhash_pairs(V.simhash_signatures(df, "id", "vec"), "id", most_distance=3).collect()}
    assert {(1, 2), (1, 3), (2, 3)} <= pairs


def test_simhash_is_complete_beyond_the_bands(spark):
    rng = np.random.default_rng(3)
    sig = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 150, dtype=np.int64)]
    for s in sig[:50]:  # bits that lie in all bands
        for most in (4, 12, 20, 21):
            sig.append(int(np.int64(s) ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.choice(63, most, replace=False).astype(np.int64)))))
    sig += sig[:3]
    df = spark.createDataFrame(list(enumerate(sig)), "id long, signature long")
    want = {(i, j, n) for i in range(len(sig)) for j in range(i + 1, len(sig)) if (n := ((sig[i] ^ sig[j]) % 2**64).bit_count()) <= 20}
    found = [(r.id_a, r.id_b, r.hamming) for r in V.simhash_pairs(df, "id", most_distance=20).collect()]
    assert len(found) == len(want) and set(found) == want


def test_similarity_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BASE_BLOCK", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (150, 8))
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x, 1)] + [(500, 0, [0.0] * 8)], "id long, label int, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    root = np.arange(1, 151)
    while True:
        new = np.array([min([root[i], *root[s[i] >= 0.8]]) for i in range(150)])
        if (new == root).all():
            break
        root = new
    want = {i + 1: root[i] for i in range(150) if (s[i] >= 0.8).any()}
    assert want and {r.id: r.component for r in V.similarity_components(df, 0.8).collect()} == want
    near = {(i + 1, j + 1) for i in range(150) for j in [j for j in np.argsort(-s[i]) if (j - i) % 3][:4] if s[i, j] >= 0.6}
    found = V.nearest_to_each(df, df, 4, group="label", exclude_same_group=True, least=0.6).collect()
    assert near and {(r.q, r.c) for r in found} == near and max(r["rank"] for r in found) <= 4


def test_queries_over_all_rows(spark, tmp_path):
    from stratoloom.plans import code, graphs, vectors

    d = str(tmp_path)
    rows = [(i, i % 2, [float(i % 5 == k) for k in range(5)]) for i in range(1, 21)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    assert {r.vec_id: r.component for r in vectors.duplicate_components_all(spark, d).collect()} == {i: (i - 1) % 5 + 1 for i in range(1, 21)}
    assert [(r.file_a, r.file_b, r.weight) for r in vectors.file_pair_max_all(spark, d).collect()] == [(0, 1, 1.0)]
    v = [[float(k == n) for k in range(64)] for n in (0, 0, 1)]
    spark.createDataFrame([(7, 1, v[0]), (8, 2, v[1]), (9, 2, v[2])], "chunk_id long, file_id long, embedding array<float>").write.parquet(f"{d}/file_chunks.parquet")
    spark.createDataFrame([(1, 1), (2, 2)], "file_id long, project_id int").write.parquet(f"{d}/indexed_files.parquet")
    assert [tuple(r) for r in code.cross_project_similarity(spark, d).collect()] == [(7, 8, 1.0)]
    assert "harmonic_all" in graphs.QUERIES


def test_text(spark):
    d = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, 121))), (2, ""), (3, None), (4, "one")], "id long, text string")
    w = {(r.id, r.chunk_index): (r.start_line, r.end_line) for r in X.line_windows(d, "id", "text").collect()}
    assert w == {(1, 0): (1, 50), (1, 1): (41, 90), (1, 2): (81, 120), (4, 0): (1, 1)}
    f = spark.createDataFrame([(1, "---\ntitle: A: b\ntitle: c\n---\nbody")], "id long, text string")
    r = X.front_matter(f, "id", "text").first()
    assert r.fields == {"title": "A: b"} and r.body == "body"
    assert T.damerau("ab", "ba", 2) == 1 and T.damerau("abc", "xyz", 2) == -1
    assert T.stem("running") == "run" and T.stem("queries") == "queri"
    h = spark.createDataFrame([("<script>x</script><p>a &amp; b</p>",)], "h string")
    assert h.select(T.strip_html("h")).first()[0] == "a & b"
    i = spark.createDataFrame([(1, "python", "import os\nfrom a.b import c\n"), (2, "Rust", "use std::io;\n"), (3, None, "import x")], "id long, lang string, text string")
    assert {(x.id, x.target) for x in X.extract_imports(i, "id", "lang", "text").collect()} == {(1, "os"), (1, "a.b"), (2, "std::io")}


def test_labels_and_divergence(spark):
    w = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "y", 4.0)], "class string, word string, weight double")
    top = {r["class"]: r.word for r in X.class_tf_idf(w, 1).collect()}
    assert top == {"a": "x", "b": "y"}
    a = spark.createDataFrame([("p", 1), ("q", 1)], "k string, n int")
    assert abs(X.js_divergence(a, a, "k", "n").first().jsd) < 1e-12
    assert X.js_divergence(a, a.where("false"), "k", "n").first().jsd == 1.0


def test_statistics(spark):
    t, c = [3.0, 4.0, 5.0, 6.0, 9.0], [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([("t", v) for v in t] + [("c", v) for v in c] + [("z", 0.0), ("t", None)], "arm string, v double")
    m = S.mann_whitney(df, "arm", "t", "c", "v").first()
    u = sum((a > b) + 0.5 * (a == b) for a in t for b in c)
    assert m.u == u and abs(m.cliffs_delta - sum(np.sign(a - b) for a in t for b in c) / 20) < 1e-12
    a = S.two_arms(df, "arm", "t", "c", "v").first()
    w = S.welch_test(a.n_t, a.mean_t, a.var_t, a.n_c, a.mean_c, a.var_c)
    assert 0 < w["p"] < 0.1
    assert abs(S.student_cdf(2.0, 10) - 0.963306) < 1e-5 and abs(S.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(S.binomial_test(8, 10) - 0.109375) < 1e-9
    assert S.adjust_pvalues([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])
    assert S.adjust_pvalues([0.01, 0.04, 0.03], "bh") == pytest.approx([0.03, 0.04, 0.04])
    b = S.bootstrap_interval(df, "arm", "t", "c", "v", rounds=200).first()
    assert b.low < b["diff"] < b.high
    r = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "x", 1)], "query string, item string, rank int")
    g = spark.createDataFrame([("q", "b", 1.0), ("q", "c", 1.0)], "query string, item string, gain double")
    x = S.retrieval_metrics(r, g, 10).first()
    assert x.reciprocal_rank == 0.5 and x.recall == 0.5 and x.average_precision == 0.25 and abs(x.ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12


def test_learning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 4) + (3 if i % 2 else -3)], "g") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, g string")
    mem, _ = M.fuzzy_c_means(df, "id", "vec", 2, iterations=20)
    sums = {r.id: r.s for r in mem.groupBy("id").agg(F.sum("membership").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    best = {r.id: r.cluster for r in mem.where("membership > 0.9").collect()}
    assert len({best[i] for i in range(0, 60, 2)}) == 1 and best[0] != best[1]
    h = {r.id: r.cluster for r in M.hdbscan(df, "g", "id", "vec").collect()}
    assert len({h[i] for i in range(0, 60, 2)}) == 1 and h[0] != h[1]
    p = M.principal_components(df, "id", "vec", 1).collect()
    assert len({r.features[0] > 0 for r in p if r.id % 2}) == 1
    assert M.move_split_merge(np.array([1, 2, 3, 2, 1.0]), np.array([1, 2, 3, 2, 1.0])) == 0
    s = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 2.0, 1.0]), (2, [1.0, 2.0, 3.0, 2.0, 1.0]), (3, [10.0, 0.0, 0.0, 0.0, 10.0]), (4, None)], "id long, v array<double>")
    assert [(r.id, r.distance) for r in M.series_neighbours(s, [(9, [1.0, 2, 3, 2, 1])], "id", "v", 2).orderBy("id").collect()] == [(1, 0.0), (2, 0.0)]


def test_bitemporal(spark):
    f = spark.createDataFrame([(1, 0, 10), (2, 5, None), (3, None, 4)], "id int, valid_from int, valid_to int")
    assert sorted(r.id for r in B.facts_at(f, 7).collect()) == [1, 2]
    assert sorted(r.id for r in B.facts_at(f, 10).collect()) == [2]
    o = B.overlaps(f.where("id = 1").withColumn("k", F.lit("k")), f.where("id = 2").withColumn("k", F.lit("k")), ["k"]).first()
    assert (o.from_, o.to_) == (5, 10)
    d = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None)], "id long, by long")
    assert sorted(r.id for r in B.supersede_loops(d, "id", "by").collect()) == [1, 2, 3]
