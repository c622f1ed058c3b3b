"""The push-stream operators as Structured Streaming queries.

Time is that of the events; a watermark says how late they may be.  State is a few numbers a key and ends
when the watermark has passed what could still change it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder, ship


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedup_ttl(events: DataFrame, key: str, ts: str, order: str, ttl_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """Events without those of a key less than ``ttl`` after the last one emitted: ``key, ts, order``.

    Within a batch events are taken in order of time; events behind the watermark are dropped.
    """
    ship(events.sparkSession)
    ttl = pd.Timedelta(seconds=ttl_seconds)
    s = events.select(key, ts, order).withWatermark(ts, lateness)
    schema = s.schema

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, order])
        keep = []
        for t in rows[ts]:
            ok = last is None or t - last >= ttl
            last = t if ok else last
            keep.append(ok)
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + ttl).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return s.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_first(events: DataFrame, key: str, ts: str, order: str, seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """The first event of a key, then none until the time since the last one emitted has passed."""
    return dedup_ttl(events, key, ts, order, seconds, lateness)


def debounce(events: DataFrame, key: str, ts: str, value: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """The last value of a key before each silence: ``key, last_ts, value``, by session windows."""
    s = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key)
    return s.agg(F.max(ts).alias("last_ts"), F.max_by(value, ts).alias(value)).select(key, "last_ts", value)


def buffer_time(events: DataFrame, key: str, ts: str, width: str, value: str, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling windows: ``key, start, n, total``."""
    w = events.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def distinct_until_changed(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Events whose value differs from the one before in arrival order: ``key, ts, value``."""
    ship(events.sparkSession)
    s = events.select(key, ts, value)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        last = state.get[0] if state.exists else None
        keep, seen = [], state.exists
        for v in rows[value].astype(str):
            keep.append(not seen or v != last)
            last, seen = v, True
        state.update((last,))
        yield rows[keep]

    return s.groupBy(key).applyInPandasWithState(step, s.schema, "last string", "append", GroupStateTimeout.NoTimeout)


def collapse_to(log: DataFrame, entity: str, seq: str, op: str, table_path: str, checkpoint: str):
    """Keeps a table of every entity's last state up to date; returns the started query.

    Each batch is collapsed, joined with the state so far and written as a new version beside the old one,
    whose name is stored last, so that a batch that is repeated after a failure changes nothing.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current_version(spark, table_path)
        both = batch if old is None else spark.read.parquet(old).select(batch.columns).unionByName(batch)
        # deletes stay in the state, so that an older change that comes late cannot revive an entity
        rest = [c for c in batch.columns if c not in (entity, seq)]
        last = both.groupBy(entity).agg(F.max(F.struct(seq, *rest)).alias("_r")).select(entity, F.col(f"_r.{seq}").alias(seq), *[F.col(f"_r.{c}").alias(c) for c in rest])
        last.select(batch.columns).write.mode("overwrite").parquet(f"{table_path}/v{number:012d}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, table_path: str) -> str | None:
    """The newest complete version of a table kept by :func:`collapse_to`."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table_path}/{n}/_SUCCESS"))]
    return f"{table_path}/{done[-1]}" if done else None


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table in memory, for tests and small reports.

    State is kept in the shared folder, which all executors reach; ``name`` must be new.
    """
    place = f"{shared_folder(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def watch_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """A stream of files as they arrive below a folder: ``path, modified_at, size_bytes, content``."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(sorted(extensions)) + "}").load(root)
    return s.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def merge_streams(*streams: DataFrame) -> DataFrame:
    """Several streams as one; it ends when all have ended."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out
