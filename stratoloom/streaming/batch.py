"""The push-stream operators over a stored stream of events.

Operators that depend on what they emitted before are done in one pass over each key's rows in order of
time, with a state of a few numbers.  Where a pause proves that the state is fresh again, a key's rows are
split there, so that a key with a third of all rows is many pieces of work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_frames


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _stateful(df: DataFrame, keys: list[str], order: list[str], step: Callable, extra: str) -> DataFrame:
    """Rows with new columns from a pass in order.  ``step(state, t) -> (state, values)``, state None at a new key.

    Rows are repartitioned by key and sorted (which spills); the pass streams over them batch by batch.
    """
    cols = [f.name for f in df.schema.fields]
    names = [c.split()[0] for c in extra.split(", ")]
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for row in zip(*[b[k] for k in keys], b["_t"], strict=True):
                if row[:-1] != last:
                    last, state = row[:-1], None
                state, values = step(state, int(row[-1]))
                out.append(values)
            new = pd.DataFrame(out, columns=names, index=b.index)
            yield pd.concat([b[cols], new], axis=1)

    return map_frames(placed, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra)


def dedup_ttl(events: DataFrame, key: list[str], ts: str, order: str, ttl_seconds: float) -> DataFrame:
    """Events without those of a key that come less than ``ttl`` after the last one emitted of it.

    Suppressed events do not extend the time.  Ties in time go by ``order``.  A pause of ``ttl`` always emits,
    so a key's rows are split at pauses.  Null times are dropped; null keys are a key.
    """
    ttl = int(ttl_seconds * 1_000_000)
    w = Window.partitionBy(*key).orderBy("_t", order)
    e = events.where(F.col(ts).isNotNull()).withColumn("_t", _micros(ts))
    fresh = F.coalesce((F.col("_t") - F.lag("_t").over(w) >= ttl).cast("int"), F.lit(1))
    e = e.withColumn("_fresh", fresh).withColumn("_piece", F.sum("_fresh").over(w)).drop("_fresh")
    e = e.withColumn("_k", F.xxhash64(*key))

    def step(last, t):
        return (t, (True,)) if last is None or t - last >= ttl else (last, (False,))

    return _stateful(e, ["_k", "_piece"], ["_t", order], step, "_emit boolean").where("_emit").select(events.columns)


def throttle_first(events: DataFrame, key: list[str], ts: str, order: str, seconds: float) -> DataFrame:
    """The first event of a key, then none until the time since the last one emitted has passed."""
    return dedup_ttl(events, key, ts, order, seconds)


def debounce(events: DataFrame, key: list[str], ts: str, order: str, seconds: float) -> DataFrame:
    """The last event of a key before each silence of at least ``seconds``, and the last of all."""
    gap = int(seconds * 1_000_000)
    w = Window.partitionBy(*key).orderBy("_t", order)
    e = events.where(F.col(ts).isNotNull()).withColumn("_t", _micros(ts)).withColumn("_next", F.lead("_t").over(w))
    return e.where(F.col("_next").isNull() | (F.col("_next") - F.col("_t") >= gap)).select(events.columns)


def distinct_until_changed(events: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Events whose value differs from the one just before (null is a value)."""
    w = Window.partitionBy(*key).orderBy(*order)
    e = events.withColumns({"_prev": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return e.where((F.col("_n") == 1) | ~F.col("_prev").eqNullSafe(F.col(value))).select(events.columns)


def numbered(events: DataFrame, order: list[str]) -> DataFrame:
    """The events with ``_index``, their place in the order over all rows, from 0.

    Range partitions are numbered each by itself; what stands before each is one number a partition.
    """
    spread = events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as there are partitions
    off = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_inner", inner).join(F.broadcast(off), "_part").withColumn("_index", F.col("_off") + F.col("_inner") - 1).drop("_part", "_off", "_inner")


def buffer_count(events: DataFrame, order: list[str], n: int) -> DataFrame:
    """The events with ``buffer``, which counts up every ``n`` events; the rest is a buffer too.  Order must have no ties."""
    return numbered(events, order).withColumn("buffer", F.floor(F.col("_index") / n)).drop("_index")


def buffer_time(events: DataFrame, key: list[str], ts: str, width: str, values: str) -> DataFrame:
    """Tumbling windows per key: ``start, n, total``; windows without events are not emitted."""
    return events.where(F.col(ts).isNotNull()).groupBy(*key, F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(values).alias("total")).select(*key, F.col("w.start").alias("start"), "n", "total")


def buffer_time_count(events: DataFrame, key: list[str], ts: str, order: str, seconds: float, n: int) -> DataFrame:
    """The events with ``buffer`` per key: it ends after ``n`` events or ``seconds`` after its first, whichever comes
    first; the next event opens a new one and sets the clock anew."""
    width = int(seconds * 1_000_000)
    e = events.where(F.col(ts).isNotNull()).withColumns({"_t": _micros(ts), "_k": F.xxhash64(*key)})

    def step(state, t):
        start, count, number = state or (None, 0, -1)
        if start is None or count >= n or t - start >= width:
            start, count, number = t, 0, number + 1
        return (start, count + 1, number), (number,)

    return _stateful(e, ["_k"], ["_t", order], step, "buffer long").drop("_t", "_k")


def collapse_changes(log: DataFrame, entity: str, seq: str, op: str) -> DataFrame:
    """The last state of every entity: its row with the greatest ``seq``, unless that is a delete."""
    rest = [c for c in log.columns if c not in (entity, seq)]
    last = log.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.max(F.struct(seq, *rest)).alias("_r"))
    return last.select(entity, F.col(f"_r.{seq}").alias(seq), *[F.col(f"_r.{c}").alias(c) for c in rest]).where(F.coalesce(F.col(op), F.lit("")) != "delete").select(log.columns)


def replay(log: DataFrame, seq: str, after: int, limit: int = 250, topics: tuple[str, list[str]] | None = None) -> DataFrame:
    """The next changes after a cursor in order, 1 to 2,000 at a time, perhaps of some topics only."""
    out = log.where(F.col(seq) > after)
    if topics:
        out = out.where(F.col(topics[0]).isin(topics[1]))
    return out.orderBy(seq).limit(max(1, min(limit, 2000)))


def retain(log: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``now``; null times are kept."""
    return log.where(F.col(ts).isNull() | (F.col(ts).cast("timestamp") >= F.expr(f"timestamp '{now}' - interval {days} days")))
