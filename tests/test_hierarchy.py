import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stratoloom.operators.hierarchy import check_stored_roots, descendants, resolve_hierarchy, with_descendant_counts

SCHEMA = "id long, parent_id long, root_id long, path string, depth string"


def brute(rows):
    parent = {i: p for i, p in rows}
    out = {}
    for i in parent:
        seen, cur, path = set(), i, [i]
        while True:
            p = parent[cur]
            if p is None or p not in parent:
                out[i] = (cur, len(path) - 1, path[::-1])
                break
            if p in seen or p == i:
                out[i] = (-1, -1, None)
                break
            seen.add(p)
            path.append(p)
            cur = p
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, p, None, "x", "y") for i, p in rows], SCHEMA)
    return {r.id: (r.true_root, r.depth, r.path) for r in resolve_hierarchy(df).collect()}


def test_deep_chain_loop_and_missing_parent(spark):
    rows = [(i, i - 1 if i else None) for i in range(70)] + [(100, 101), (101, 102), (102, 100), (103, 101), (200, 999), (300, 300), (400, None)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_empty_nulls_and_repeated_rows(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, 1, 1, None, None), (2, 1, 1, "p", "d")], SCHEMA)
    assert {r.id: r.depth for r in resolve_hierarchy(df).collect()} == {1: 0, 2: 1}


def test_descendants_and_stored_roots(spark):
    df = spark.createDataFrame([(1, None, None, "", ""), (2, 1, 1, "", ""), (3, 2, 9, "", ""), (4, 5, 4, "", ""), (5, 4, 4, "", "")], SCHEMA)
    r = resolve_hierarchy(df)
    assert {tuple(x) for x in descendants(r).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
    assert {x.id: x.n_descendants for x in with_descendant_counts(r).collect()} == {1: 2, 2: 1, 3: 0, 4: None, 5: None}
    assert {x.id: x.true_root for x in check_stored_roots(df, r).collect()} == {3: 1, 4: -1, 5: -1}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 11)), min_size=1, max_size=10))
def test_random_forests(spark, parents):
    rows = list(enumerate(parents))
    assert run(spark, rows) == brute(rows)
