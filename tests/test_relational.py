import pytest
from pyspark.sql import functions as F

from stratoloom.functions.predicates import Fields, combine, glob_match, predicate
from stratoloom.operators import aggregates as A
from stratoloom.operators import history as H
from stratoloom.operators import joins as J
from stratoloom.operators import windows as W
from stratoloom.session import broadcast_if_small, few_or_raise
from stratoloom.sources.tables import latest


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(1, '{"a": 1, "t": "Ab%c"}'), (2, '{"a": 1.0}'), (3, '{"a": null}'), (4, "{}"), (5, '{"a": "x"}'), (6, None), (7, '{"a": 7, "t": ""}')], "id int, j string"
    )


def test_predicates_on_json(docs):
    f = Fields("j")
    assert ids(docs.where(predicate(f, "a", "eq", 1))) == [1, 2]
    assert ids(docs.where(predicate(f, "a", "ne", 1))) == [3, 4, 5, 6, 7]
    assert ids(docs.where(predicate(f, "a", "gt", 0))) == [1, 2, 7]
    assert ids(docs.where(predicate(f, "a", "exists"))) == [1, 2, 3, 5, 7]
    assert ids(docs.where(predicate(f, "t", "contains", "B%C"))) == [1]
    assert ids(docs.where(combine(f, [("a", "eq", 7), ("t", "contains", "ab")], any_of=True))) == [1, 7]
    assert len(ids(docs.where(combine(f, [])))) == 7
    with pytest.raises(ValueError):
        predicate(f, "a", "like", "x")


def test_glob_is_literal_elsewhere(spark):
    df = spark.createDataFrame([(1, "a_b.rs"), (2, "axb.rs"), (3, None)], "id int, p string")
    assert ids(df.where(glob_match("p", "a_*.rs"))) == [1]


def test_aggregates(spark):
    df = spark.createDataFrame([("lat", "10.0"), ("lat", "20.0"), ("lat", "bad"), ("tput", "4200"), (None, None)], "metric string, value string")
    got = {r.metric: r for r in A.aggregate(df, ["metric"], [A.Metric("avg", "value"), A.Metric("median", "value"), A.Metric("count"), A.Metric("stddev", "value")]).collect()}
    assert (got["lat"].avg_value, got["lat"].median_value, got["lat"]["count"], got["lat"].n_ignored_value) == (15, 15, 3, 1)
    assert got["tput"].stddev_value == 0 and got[None].avg_value is None
    one = A.aggregate(df.where("false"), [], [A.Metric("count"), A.Metric("sum", "value")]).collect()
    assert len(one) == 1 and one[0]["count"] == 0 and one[0].sum_value is None
    with pytest.raises(ValueError):
        A.aggregate(df, [], [A.Metric("sum", "value")], Fields(types={"value": "text"}))


def test_rollup_is_a_mean_of_means(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 10.0), ("b", "z", 4.0)], "g string, h string, v double")
    got = {(r.level, r.key): r.v for r in A.rollup_means(df, ["g", "h"], ["v"]).collect()}
    assert got[("g", "a")] == 6.0 and got[("all", None)] == 5.0


def test_windows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 1, 1, 3, None])], "id int, v int")
    assert {r.id: r.pr for r in W.percent_rank(df, "v", "pr").collect()} == {4: 0.0, 1: 0.25, 2: 0.25, 3: 0.75, 0: 1.0}
    g = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", None)], "g string, n int")
    assert {(r.g, r.first, r.last, r.length) for r in W.gaps_and_islands(g, ["g"], "n").collect()} == {("a", 1, 2, 2), ("a", 5, 5, 1)}
    assert W.top_per_group(g, ["g"], [F.desc("n")], 1).count() == 2
    d = spark.createDataFrame([("k", "x"), ("k", "y"), ("k", "y"), ("l", "b"), ("l", "a")], "k string, c string")
    assert {(r.k, r.c) for r in W.dominant(d, ["k"], "c").collect()} == {("k", "y"), ("l", "a")}


def test_rank_fusion(spark):
    leg = lambda rows: spark.createDataFrame(rows, "id string, rank int")
    got = {r.id: r.score for r in J.rank_fusion([(leg([("a", 1), ("b", 2), (None, 3)]), 1.0), (leg([("b", 1), ("b", 5)]), 1.0)]).collect()}
    assert abs(got["a"] - 1 / 61) < 1e-12 and abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-12


def test_range_as_of_and_phases(spark):
    pts = spark.createDataFrame([(1, "f", 5), (2, "f", 400), (3, "g", 5), (4, "f", None)], "pid int, f string, line int")
    rng = spark.createDataFrame([(10, "f", 1, 900), (11, "f", 3, 6), (12, "f", None, 9)], "rid int, f string, s int, e int")
    assert {(r.pid, r.rid) for r in J.innermost(pts, rng, "f", "pid", "line", "s", "e", "rid").collect()} == {(1, 11), (2, 10)}
    left = spark.createDataFrame([("k", 5), ("k", 1), ("m", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "v2"), ("k", 5, "v5"), ("k", None, "v0")], "k string, rt int, v string")
    assert {(r.k, r.t, r.v) for r in J.as_of_join(left, right, ["k"], "t", "rt", ["v"]).collect()} == {("k", 5, "v5"), ("k", 1, None), ("m", 5, None)}
    rows = spark.createDataFrame([("x", "p", "q"), ("y", "z", "q"), ("z", "z", "z")], "id string, a string, b string")
    c = spark.createDataFrame([("p", "q", "t1"), ("w", "q", "t0")], "a string, b string, t string")
    assert {(r.id, r.target, r.phase) for r in J.first_match(rows, "id", [(c, ["a"], "t"), (c, ["b"], "t")]).collect()} == {("x", "t1", 0), ("y", "t0", 1), ("z", None, None)}


def test_co_change(spark):
    rows = [("1", x) for x in "ab"] + [("2", x) for x in "ab"] + [("3", x) for x in "abcd"] + [("4", "c"), ("5", "e"), ("5", "e"), (None, "a")]
    got = {(r.item_a, r.item_b): round(r.jaccard, 4) for r in H.co_change(spark.createDataFrame(rows, "c string, f string"), "c", "f").collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.25, ("a", "d"): 0.3333, ("b", "c"): 0.25, ("b", "d"): 0.3333, ("c", "d"): 0.5}


def test_cusum_finds_the_shift(spark):
    rows = [("s", i, 1.0 if i < 20 else 6.0) for i in range(40)] + [("flat", i, 2.0) for i in range(10)] + [("short", 1, 9.0)]
    got = H.cusum_change_points(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v").collect()
    assert [r.k for r in got] == ["s"]


def test_latest_and_guards(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (1, 9, "new"), (2, None, "n"), (None, 1, "x")], "k int, at int, v string")
    assert {(r.k, r.v) for r in latest(df, "k", "at").collect()} == {(1, "new"), (2, "n")}
    with pytest.raises(ValueError):
        few_or_raise(df, 2, "rows")
    assert broadcast_if_small(df).count() == 5 and broadcast_if_small(df, 0).count() == 5
