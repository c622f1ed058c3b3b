import pytest
from pyspark.sql import functions as F

from stratoloom.operators import collectors as C
from stratoloom.operators import graph_local as L
from stratoloom.operators.history import cusum_change_points
from stratoloom.operators.imports import resolve_imports
from stratoloom.operators.quality import inheritance_depth
from stratoloom.operators.hierarchy import resolve_hierarchy, with_descendant_counts


def test_imports_lead_to_files(spark):
    files = [(1, 1, "src/app/main.py"), (2, 1, "src/app/util.py"), (3, 1, "src/pkg/__init__.py"), (4, 1, "web/a/x.js"), (5, 1, "web/b/y.js"), (6, 2, "src/app/util.py"), (7, 1, "src/main/java/p/Q.java"), (8, 1, None), (9, None, "a.py")]
    df = spark.createDataFrame(files, "file_id long, project_id int, relative_path string")
    imports = [(1, "app.util"), (1, "pkg"), (1, "os"), (4, "../b/y.js"), (4, "./x"), (5, "react"), (7, "p.Q.inner"), (2, "p.Q"), (6, "app.util.f"), (9, "app.util"), (1, "app.util")]
    got = {(r.src, r.dst, r.target) for r in resolve_imports(spark.createDataFrame(imports, "id long, target string"), df).collect()}
    assert got == {(1, 2, "app.util"), (1, 3, "pkg"), (4, 5, "../b/y.js"), (2, 7, "p.Q")}
    assert resolve_imports(spark.createDataFrame([], "id long, target string"), df).count() == 0


def test_findings_and_scores(spark):
    rows = [(1, "from a import *\neval(x)\n# TODO b\n# TODO c\n"), (2, None), (3, ""), (4, "try:\n  f()\nexcept E: pass\nhashlib.md5(x) a.b@c.org")]
    df = spark.createDataFrame(rows, "file_id long, content string")
    got = {(r.id, r.collector, r.hits) for r in C.pattern_findings(df).collect()}
    assert got == {(1, "wildcard_import", 1), (1, "dynamic_code", 1), (1, "marker", 2), (4, "swallowed_error", 1), (4, "weak_hash", 1), (4, "mail_address", 1)}
    s = {r.collector: r.score for r in C.pillar_scores(df).collect()}
    assert len(s) == len(C.FINDINGS) and s["marker"] == pytest.approx(200 / 3) and s["card_number"] == 100
    assert {r.score for r in C.pillar_scores(df.where("false")).collect()} == {100.0}


def test_gaps_in_tests_and_use(spark):
    files = spark.createDataFrame([(1, 1, "src/a.py"), (2, 1, "tests/test_a.py"), (3, 1, "src/b.py"), (4, 2, "src/a.py"), (5, 1, None)], "file_id long, project_id int, relative_path string")
    assert {r.id for r in C.untested_files(files).collect()} == {3, 4}
    symbols = spark.createDataFrame([(1, "def", "function", "f", 1, 3), (1, "def", "function", "C.g", 4, 4), (3, "ref", "call", "g", 2, 2), (4, "def", "function", "g", 1, 1), (3, "def", "function", "main", 1, 1)], "file_id long, what string, kind string, name string, start_line int, end_line int")
    assert {(r.file_id, r.name, r.lines) for r in C.unused_functions(symbols, files).collect()} == {(1, "f", 3), (4, "g", 1)}
    edges = spark.createDataFrame([(1, 3)], "src long, dst long")
    assert {r.id for r in C.orphan_files(edges, files).collect()} == {4}


def test_cycles_of_any_length():
    import numpy as np

    n = 40
    ring = np.array([(i, (i + 1) % n) for i in range(n)] + [(5, 3), (7, 7)])
    got = sorted(L.simple_cycles(np.arange(n), ring), key=lambda x: x[1])
    assert got == [("7", 1), ("3>4>5", 3), (">".join(map(str, range(n))), n)]
    full = np.array([(a, b) for a in range(5) for b in range(5) if a != b])
    assert len(L.simple_cycles(np.arange(5), full)) == 10 + 20 + 30 + 24
    with pytest.raises(ValueError):
        L.simple_cycles(np.arange(5), full, most=50)


def test_a_tie_with_the_threshold_is_no_change(spark):
    # sigma 2/3 and the greatest sum 4/3
    rows = [("k", i, x) for i, x in enumerate([1.0, 3.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0])]
    s = spark.createDataFrame(rows, "k string, t int, x double")
    one = cusum_change_points(s, "k", "t", "x", threshold=0.1).first()
    tied = one.peak / one.sigma
    assert cusum_change_points(s, "k", "t", "x", threshold=tied * (1 - 1e-6)).count() == 1
    for nudge in (0, 1e-16, -2e-16):
        assert cusum_change_points(s, "k", "t", "x", threshold=tied + nudge).count() == 0


def test_depth_of_several_parents_and_loops(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("e", "nowhere"), (None, "a")]
    got = {r.id: (r.dit, r.noc) for r in inheritance_depth(spark.createDataFrame(rows, "n string, p string"), "n", "p").collect()}
    assert got == {"a": (0, 2), "b": (1, 1), "c": (2, 0), "e": (0, 0), "x": (None, 2), "y": (None, 1), "z": (None, 0)}


def test_descendants_of_long_chains(spark):
    items = [(i, i - 1 if i else None) for i in range(37)] + [(100 + i, 5) for i in range(4)] + [(200, 201), (201, 200), (300, 200)]
    df = spark.createDataFrame(items, "id long, parent_id long")
    got = {r.id: r.n_descendants for r in with_descendant_counts(resolve_hierarchy(df)).collect()}
    assert got[0] == 40 and got[5] == 35 and got[6] == 30 and got[36] == 0 and got[103] == 0 and got[300] is None
    assert with_descendant_counts(resolve_hierarchy(df.where(F.lit(False)))).count() == 0
