"""Lock orders, channels and data flow inside functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import strong_components, transitive_closure


def lock_order(events: DataFrame) -> DataFrame:
    """Edges ``src, dst, places``: a function takes ``dst`` while it holds ``src``.

    ``events`` has ``function, seq, lock, op`` (acquire or release).  A lock is held from its acquire to its
    release, or to the function's end.
    """
    w = Window.partitionBy("function", "lock").orderBy("seq")
    e = events.withColumn("until", F.lead(F.when(F.col("op") == "release", F.col("seq"))).over(w))
    a = e.where("op = 'acquire'").select("function", "lock", "seq", "until")
    b = a.select("function", F.col("lock").alias("dst"), F.col("seq").alias("s2"))
    held = a.join(b, "function").where("s2 > seq and dst <> lock and (until is null or s2 < until)")
    return held.groupBy(F.col("lock").alias("src"), "dst").agg(F.countDistinct("function").alias("places"))


def deadlock_candidates(order: DataFrame) -> DataFrame:
    """Locks that can be taken in a circle: ``id, component`` of the components of two and more."""
    c = strong_components(order.select("src", "dst"))
    big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return c.join(big.select("component"), "component").select("id", "component")


def channel_balance(ops: DataFrame) -> DataFrame:
    """Channels with senders but no receivers or the other way round: ``channel, sends, receives, verdict``.

    ``ops`` has ``channel, op`` (send or receive).
    """
    c = ops.groupBy("channel").agg(F.count(F.when(F.col("op") == "send", 1)).alias("sends"), F.count(F.when(F.col("op") == "receive", 1)).alias("receives"))
    v = F.when(F.col("receives") == 0, "never received").when(F.col("sends") == 0, "never sent").otherwise("matched")
    return c.withColumn("verdict", v)


def waiting_circles(ops: DataFrame) -> DataFrame:
    """Actors that wait for each other in a circle: ``id, component``; ``ops`` has ``actor, channel, op``."""
    r = ops.where("op = 'receive'").select(F.col("actor").alias("src"), "channel")
    s = ops.where("op = 'send'").select(F.col("actor").alias("dst"), "channel")
    return deadlock_candidates(r.join(s, "channel").where("src <> dst").select("src", "dst").distinct())


def tainted(flows: DataFrame, sources: DataFrame, sinks: DataFrame, sanitisers: DataFrame | None = None) -> DataFrame:
    """Sinks that data of a source reaches: ``source, sink, hops``.

    ``flows`` has ``src, dst``; the others have ``id``.  Flows into a sanitiser end there.
    """
    f = flows.select("src", "dst")
    if sanitisers is not None:
        f = f.join(sanitisers.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    c = transitive_closure(f)
    return c.join(sources.select(F.col("id").alias("src")).distinct(), "src").join(sinks.select(F.col("id").alias("dst")).distinct(), "dst").select(F.col("src").alias("source"), F.col("dst").alias("sink"), "hops")


def effects(calls: DataFrame, direct: DataFrame) -> DataFrame:
    """Effects of functions by what they call: ``function, effect, hops`` (0: their own).

    ``calls`` has ``src, dst``, ``direct`` has ``function, effect``.
    """
    own = direct.select("function", "effect").distinct()
    c = transitive_closure(calls.select("src", "dst"))
    far = c.join(own.select(F.col("function").alias("dst"), "effect"), "dst").select(F.col("src").alias("function"), "effect", "hops")
    return own.withColumn("hops", F.lit(0)).unionByName(far).groupBy("function", "effect").agg(F.min("hops").alias("hops"))


def is_a_cover(attributes: DataFrame) -> DataFrame:
    """The direct ``src is_a dst`` links between concepts by their attribute sets: ``src, dst``.

    ``attributes`` has ``concept, attribute``.  A concept is a kind of another if it has all its attributes and
    more; links that follow from two others are left out.  Equal concepts are linked to none.
    """
    a = attributes.select("concept", "attribute").distinct()
    n = a.groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    shared = a.select(F.col("concept").alias("src"), "attribute").join(a.select(F.col("concept").alias("dst"), "attribute"), "attribute").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    sub = shared.join(n.select(F.col("concept").alias("dst"), F.col("n").alias("nd")), "dst").join(n.select(F.col("concept").alias("src"), F.col("n").alias("ns")), "src").where("c = nd and ns > nd").select("src", "dst")
    via = sub.select("src", F.col("dst").alias("mid")).join(sub.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
    return sub.join(via, ["src", "dst"], "left_anti")
