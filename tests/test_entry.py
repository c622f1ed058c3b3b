import re

import __spark_entry__ as entry
from stratoloom.plans import core_queries


def test_registry_is_consistent():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(core_queries()) > 100
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in q)


def test_core_queries_run_on_the_smallest_data(spark, data):
    for name in ("p4_found", "agg_all_eight", "join_inner_star", "dedup_ttl", "hot_path", "churn"):
        assert core_queries()[name](spark, data).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
