import math
import random

import pytest
from pyspark.sql import functions as F

from stratoloom.operators import acceptance, concurrency as C
from stratoloom.operators import graph_local as L
from stratoloom.operators import quality as Q
from stratoloom.operators import stats as S
from stratoloom.operators import symbols as Y
from stratoloom.operators import topics as T
from stratoloom.plans import jobs
from stratoloom.sources import sinks
from stratoloom.streaming import live


def test_more_local_graph(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 3, 4), ("g", 5, 1)], "p string, src long, dst long")
    run = lambda f, s: L.per_group(e, "p", f, s).collect()
    assert {(r.cycle, r.length) for r in run(L.simple_cycles, "cycle string, length int")} == {("1>2>3", 3)}
    assert {r.id: r.role for r in run(L.core_periphery, "id long, role string")} == {1: "core", 2: "core", 3: "core", 4: "shared", 5: "control"}
    assert {r.id: r.c for r in run(L.two_edge_components, "id long, c long")} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {(r.a, r.b): r.s for r in run(L.edge_betweenness, "a long, b long, s double")}[(3, 4)] == 4
    assert run(L.attack, "removed int, largest int")[0].largest == 5


def test_concurrency(spark):
    ev = spark.createDataFrame([("f", 1, "A", "acquire"), ("f", 2, "B", "acquire"), ("f", 3, "B", "release"), ("f", 4, "A", "release"), ("f", 5, "C", "acquire"), ("g", 1, "B", "acquire"), ("g", 2, "A", "acquire")], "function string, seq int, lock string, op string")
    order = C.lock_order(ev)
    assert {(r.src, r.dst) for r in order.collect()} == {("A", "B"), ("B", "A")}
    assert {r.id for r in C.deadlock_candidates(order).collect()} == {"A", "B"}
    ops = spark.createDataFrame([("p", "c", "send"), ("q", "c", "receive"), ("q", "d", "send"), ("p", "d", "receive"), ("p", "e", "send")], "actor string, channel string, op string")
    assert {r.channel: r.verdict for r in C.channel_balance(ops).collect()} == {"c": "matched", "d": "matched", "e": "never received"}
    assert {r.id for r in C.waiting_circles(ops).collect()} == {"p", "q"}
    fl = spark.createDataFrame([("in", "a"), ("a", "clean"), ("clean", "db"), ("a", "log")], "src string, dst string")
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    assert {(r.sink, r.hops) for r in C.tainted(fl, one("in"), one("db", "log"), one("clean")).collect()} == {("log", 2)}
    at = spark.createDataFrame([("dog", "legs"), ("dog", "barks"), ("animal", "legs"), ("puppy", "legs"), ("puppy", "barks"), ("puppy", "small")], "concept string, attribute string")
    assert {(r.src, r.dst) for r in C.is_a_cover(at).collect()} == {("dog", "animal"), ("puppy", "dog")}
    eff = C.effects(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), spark.createDataFrame([("c", "io")], "function string, effect string"))
    assert {(r.function, r.hops) for r in eff.collect()} == {("a", 2), ("b", 1), ("c", 0)}


def test_acceptance_trees():
    arms = {"n_t": 40, "mean_t": 5.0, "var_t": 1.0, "median_t": 5.0, "n_c": 40, "mean_c": 4.0, "var_c": 1.0, "median_c": 4.0}
    tree = {"kind": "all", "of": [{"kind": "significant", "direction": "greater"}, {"kind": "effect_at_least", "d": 0.8}, {"kind": "not", "of": {"kind": "equivalent", "margin": 0.2}}, {"kind": "relative_change", "least": 0.2}, {"kind": "threshold", "most": 5.0}]}
    assert acceptance.evaluate(tree, arms)["accepted"]
    assert not acceptance.evaluate({"kind": "significant", "direction": "less"}, arms)["accepted"]
    with pytest.raises(ValueError):
        acceptance.evaluate({"kind": "maybe"}, arms)


def test_normality():
    rnd = random.Random(1)
    assert S.anderson_darling([(rnd.gauss(0, 1), 1) for _ in range(400)])["p"] > 0.01
    assert S.anderson_darling([(rnd.expovariate(1), 1) for _ in range(400)])["p"] < 1e-4
    assert math.isnan(S.anderson_darling([(1.0, 3)])["p"])


def test_symbols_and_calls(spark):
    files = spark.createDataFrame([(1, 7, "python", "def a():\n    b()\n    c.d()\n\nclass K:\n    def m(self):\n        a()\n"), (2, 7, "rust", "pub fn b() {\n    helper();\n}\nfn helper() {}\n"), (3, 7, "python", "def ("), (4, 7, None, "x"), (5, 7, "go", None)], "file_id long, project_id int, language string, content string")
    sy = Y.extract_symbols(files)
    assert {r.name for r in sy.where("what = 'def'").collect()} == {"a", "K", "K.m", "b", "helper"}
    g = {(r.caller, r.callee) for r in Y.call_graph(sy, files).collect()}
    assert {("1:a", "2:b"), ("1:K.m", "1:a"), ("2:b", "2:helper"), ("1:a", None)} <= g
    assert {r.name: r.lines for r in Y.function_metrics(sy, files).collect()}["a"] == 3


def test_topics_and_quality(spark):
    h = T.topic_histogram(spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", 1), ("q", None), (None, 1)], "project string, topic_id int"), "project")
    assert {(r.project, r.topic_id): round(r.share, 3) for r in h.collect()} == {("p", 1): 0.667, ("p", 2): 0.333, ("q", 1): 1.0}
    assert {r.project: r.normalised for r in T.topic_profile(h, "project").collect()}["q"] == 0
    im = spark.createDataFrame([("a", "t"), ("b", "a")], "src string, dst string")
    co = spark.createDataFrame([("t", "a", 1.0), ("x", "t", 0.5)], "a string, b string, weight double")
    sim = spark.createDataFrame([("t", "y", 0.9)], "a string, b string, weight double")
    assert {(r.id, round(r.score, 3), r.source) for r in Q.change_impact(im, co, sim, "t").collect()} == {("a", 1.0, "import"), ("b", 0.333, "import"), ("x", 0.4, "co-change"), ("y", 0.45, "similar")}
    own = spark.createDataFrame([("f1", "ann", 5), ("f2", "ann", 5), ("f3", "bob", 1), ("f2", "bob", 9)], "file string, author string, lines int")
    assert Q.reviewers(own, ["f1", "f2", "f3"]) == [("ann", 2), ("bob", 1)]
    d = {r.id: (r.dit, r.noc) for r in Q.inheritance_depth(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "zz")], "name string, parent string"), "name", "parent").collect()}
    assert d == {"a": (0, 2), "b": (1, 1), "c": (2, 0), "d": (0, 0)}
    assert Q.compression_distance("abc" * 200, "abc" * 200) < 0.2 < Q.compression_distance("abc" * 200, "".join(map(chr, range(300, 900))))
    words = spark.createDataFrame([(["search", "the", "index"],)] * 5 + [(["search", "results"],)] * 3, "words array<string>")
    assert Q.BigramModel(Q.ngram_counts(words, 2)).correct(["serch", "reslts"]) == ["search", "results"]


def test_jobs(spark, tmp_path, data):
    (tmp_path / "w/src").mkdir(parents=True)
    (tmp_path / "w/src/a.py").write_text("import os\n")
    jobs.index_workspace(spark, str(tmp_path / "w"), None, str(tmp_path / "o1"))
    (tmp_path / "w/src/b.py").write_text("import sys\n")
    jobs.index_workspace(spark, str(tmp_path / "w"), str(tmp_path / "o1"), str(tmp_path / "o2"))
    assert spark.read.parquet(str(tmp_path / "o2/files.parquet")).count() == 2
    assert [r.target for r in spark.read.parquet(str(tmp_path / "o2/imports.parquet")).collect()] == ["sys"]
    jobs.label_topics(spark, data, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/topic_words.parquet")).count() > 0
    jobs.analyse_graph(spark, data, str(tmp_path / "g"))
    assert "rank" in spark.read.parquet(str(tmp_path / "g/file_metrics.parquet")).columns
    spark.createDataFrame([(1, "ann", "2024-01-01", "fix x"), (2, "bob", "2024-02-01", "add")], "commit_id int, author string, author_date string, subject string").write.parquet(str(tmp_path / "h/commits.parquet"))
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "commit_id int, file_path string").write.parquet(str(tmp_path / "h/commit_files.parquet"))
    jobs.measure_history(spark, str(tmp_path / "h"), str(tmp_path / "ho"), "2024-03-01")
    assert spark.read.parquet(str(tmp_path / "ho/co_change.parquet")).first().jaccard == 1.0


def test_edn_and_watching(spark, tmp_path):
    assert sinks.ontology_edn(spark.createDataFrame([('a"b', "c")], "src string, dst string")).first().value == '[:is-a "a\\"b" "c"]'
    (tmp_path / "x.py").write_text("1")
    got = live.run_to_end(live.watch_files(spark, str(tmp_path), ["py"]).select("content"), "watched")
    assert [r.content for r in got.collect()] == ["1"]
    a = live.watch_files(spark, str(tmp_path), ["py"]).select(F.lit(1).alias("x"))
    assert live.run_to_end(live.merge_streams(a, a), "merged").count() == 2


def test_hyperbolic_embedding_and_silhouette():
    import numpy as np

    from stratoloom.operators import learning as M

    edges = [(f"c{i}", f"p{i % 4}") for i in range(16)] + [(f"p{i}", "root") for i in range(4)]
    r = {k: np.array(v) for k, v in M.poincare_embedding(edges, epochs=100).items()}

    def d(a, b):
        u, v = r[a], r[b]
        return np.arccosh(1 + 2 * ((u - v) ** 2).sum() / ((1 - u @ u) * (1 - v @ v)))

    assert np.mean([d(a, b) for a, b in edges]) < np.mean([d(f"c{i}", f"p{(i + 1) % 4}") for i in range(16)])
    assert all(np.linalg.norm(v) < 1 for v in r.values())
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.1, (20, 2)), np.random.default_rng(1).normal(3, 0.1, (20, 2))])
    assert M.fuzzy_silhouette(x, np.array([[0, 0], [3, 3.0]])) > 0.9


def test_compression_pairs_meet_every_file_of_the_project(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from stratoloom.operators import quality
    from stratoloom.plans import code

    monkeypatch.setattr(code, "COMPRESSION_BLOCK", (2, 1))
    ids = [(100, 1), (200, 1), (3, 1), (104, 1), (250, 1), (300, 2), (5, 2), (6, 3), (400, None)]
    text = {i: f"file {i % 7} " * (i % 9 + 3) for i, _ in ids}
    rows = [(i, datetime(2024, 1, 1), p, "python", text[i]) for i, p in ids] + [(7, datetime(2024, 1, 1), 1, "python", None)]
    spark.createDataFrame(rows, "file_id long, indexed_at timestamp, project_id int, language string, content string").write.parquet(f"{tmp_path}/indexed_files.parquet")
    found = {(r.a, r.b): r.distance for r in code.compression_pairs(spark, str(tmp_path)).collect()}
    pairs = {(100, 200), (100, 3), (100, 104), (100, 250), (200, 3), (200, 104), (200, 250), (300, 5)}
    assert found == {(a, b): quality.compression_distance(text[a], text[b]) for a, b in pairs}
