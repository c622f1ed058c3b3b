import datetime as dt

from pyspark.sql import functions as F

from stratoloom.streaming import batch as S
from stratoloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=s) if s is not None else None, v) for i, (k, s, v) in enumerate(rows)], "id long, k string, ts timestamp, v string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_dedup_debounce_distinct(spark):
    e = events(spark, [("a", 0, "1"), ("a", 4, "1"), ("a", 9, "2"), ("a", 12, "2"), ("b", 1, "1"), (None, 1, "x"), (None, 2, "x"), ("a", None, "z")])
    assert ids(S.dedup_ttl(e, ["k"], "ts", "id", 10)) == [0, 3, 4, 5]
    assert ids(S.debounce(e, ["k"], "ts", "id", 5)) == [1, 3, 4, 6]
    assert ids(S.distinct_until_changed(e.where("ts is not null"), ["k"], ["ts", "id"], "v")) == [0, 2, 4, 5]


def test_wide_windows_emit_the_first_only(spark):
    e = events(spark, [("a", i, str(i)) for i in range(3)])
    assert ids(S.throttle_first(e, ["k"], "ts", "id", 3600)) == [0]


def test_buffers(spark):
    e = events(spark, [("a", i, str(i)) for i in range(7)])
    b = {r.id: r.buffer for r in S.buffer_count(e, ["ts", "id"], 3).collect()}
    assert [b[i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2]
    c = {r.id: r.buffer for r in S.buffer_time_count(e, ["k"], "ts", "id", 3600, 3).collect()}
    assert [c[i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2]
    assert S.buffer_count(e.where("false"), ["ts", "id"], 3).count() == 0


def test_collapse_and_replay(spark):
    log = spark.createDataFrame([("x", 1, "upsert", "a"), ("x", 3, "upsert", "b"), ("y", 2, "upsert", "c"), ("y", 4, "delete", None)], "e string, seq long, op string, v string")
    assert [(r.e, r.v) for r in S.collapse_changes(log, "e", "seq", "op").collect()] == [("x", "b")]
    assert [r.seq for r in S.replay(log, "seq", 1, 2).collect()] == [2, 3]


def test_live_equals_batch(spark, tmp_path):
    rows = [("a", 0, "1"), ("a", 4, "1"), ("a", 9, "2"), ("a", 12, "2"), ("b", 1, "1"), ("b", 30, "1"), ("a", 33, "3")]
    e = events(spark, rows)
    for i in range(3):
        e.where(F.col("id").between(i * 3, i * 3 + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.read_folder(spark, str(tmp_path / "in"), e.schema)
    got = live.run_to_end(live.dedup_ttl(stream, "k", "ts", "id", 10), "dedup")
    assert ids(got) == ids(S.dedup_ttl(e, ["k"], "ts", "id", 10))
    got = live.run_to_end(live.distinct_until_changed(stream, "k", "ts", "v"), "changed")
    assert got.count() == S.distinct_until_changed(e, ["k"], ["ts", "id"], "v").count()
    got = live.run_to_end(live.buffer_time(stream, "k", "ts", "10 seconds", "id"), "buffered", "complete")
    assert {(r.k, r.n, r.total) for r in got.collect()} == {(r.k, r.n, r.total) for r in S.buffer_time(e, ["k"], "ts", "10 seconds", "id").collect()}


def test_live_collapse_keeps_the_last_state(spark, tmp_path):
    schema = "e string, seq long, op string, v string"
    a = spark.createDataFrame([("x", 1, "upsert", "a"), ("y", 2, "upsert", "c")], schema)
    b = spark.createDataFrame([("x", 3, "upsert", "b"), ("y", 4, "delete", None)], schema)
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    q = live.collapse_to(live.read_folder(spark, str(tmp_path / "log"), a.schema), "e", "seq", "op", str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination()
    state = spark.read.parquet(live.current_version(spark, str(tmp_path / "state")))
    assert {(r.e, r.v) for r in state.where("op <> 'delete'").collect()} == {("x", "b")}
