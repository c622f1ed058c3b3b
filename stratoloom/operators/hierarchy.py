"""Parent-child rows turned into full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts


def resolve_hierarchy(items: DataFrame, id_col: str = "id", parent_col: str = "parent_id", with_path: bool = True) -> DataFrame:
    """For every node its root, depth and (optionally) path, with loops marked.

    ``items`` holds one row per node.  Returns ``id, true_root, depth`` and with ``with_path``
    also ``path``, the ids from the root to the node.  A node whose parent is null or does not
    exist is a root of depth 0.  A node whose parents lead into a loop (a node that is its own
    parent included) has true_root -1, depth -1 and a null path.  Rows with a null id are
    dropped; of several rows with one id that with the smallest parent counts (null last);
    an empty table gives an empty result.

    Pointer doubling: every open node holds the ancestor 2^k steps up, its distance and the path
    segment between; each round joins the pointers with themselves.  Depths leave no gaps, so the
    first round that settles no node has only loops left: the number of rounds is the logarithm
    of the greatest depth plus two, whatever the number of loops.  Only open nodes move; the hub
    that holds many children is settled (and its children with it) as soon as its own root is
    known, and a hot pointer is split by AQE, its other side being one row.
    """
    spark = items.sparkSession
    cuts = Cuts(spark, "hierarchy")
    nodes = (
        items.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.min(F.col(parent_col).cast("long")).alias("parent"))
    )
    known = nodes.select(F.col("id").alias("p"))
    state = nodes.join(known, nodes.parent == known.p, "left").select(
        "id",
        F.coalesce("p", "id").alias("up"),
        F.col("p").isNull().alias("done"),
        F.when(F.col("p").isNull(), 0).otherwise(1).cast("int").alias("dist"),
        F.array("id").alias("seg"),
    )
    if not with_path:
        state = state.drop("seg")
    state = cuts.cut(state)
    done, open_ = state.where("done"), state.where("not done")
    settled, left = [done], open_.count()
    # what the pointers of a round lead to: all nodes at the same number of doublings
    while left:
        above = done.unionByName(open_) if len(settled) == 1 else settled[0].unionByName(open_)
        for s in settled[1:]:
            above = above.unionByName(s)
        above = above.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"), F.col("dist").alias("dist2"), *([F.col("seg").alias("seg2")] if with_path else []))
        step = open_.join(above, "up").select(
            "id",
            F.col("up2").alias("up"),
            F.col("done2").alias("done"),
            (F.col("dist") + F.col("dist2")).alias("dist"),
            *([F.concat("seg2", "seg").alias("seg")] if with_path else []),
        )
        step = cuts.cut(step)
        now_open = step.where("not done")
        n = now_open.count()
        settled.append(step.where("done"))
        if n == left:
            break
        open_, left = now_open, n
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    cols = ["id", F.col("up").alias("true_root"), F.col("dist").alias("depth")] + ([F.col("seg").alias("path")] if with_path else [])
    out = out.select(*cols)
    if left:
        loop = [F.lit(-1).cast("long").alias("true_root"), F.lit(-1).alias("depth")] + ([F.lit(None).cast("array<long>").alias("path")] if with_path else [])
        out = out.unionByName(open_.select("id", *loop))
    return out


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) triples, distance 1 and more, from the paths.

    Takes the result of :func:`resolve_hierarchy`; nodes in or below a loop have no path and
    give none.  The list of a node is rows, never one collected cell, so a root over a third of
    all nodes costs no task more than another.
    """
    steps = resolved.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor"))
    return steps.where("level < depth").select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))


def with_descendant_counts(resolved: DataFrame) -> DataFrame:
    """The resolved nodes with ``n_descendants`` (0 for leaves, null for nodes in or below a loop).

    By doubling, without a row per ancestor: how many nodes lie less than 2^(k+1) below a node is how
    many lie less than 2^k below it, plus as many for each node exactly 2^k below.  The rounds grow
    with the logarithm of the depth, and a round moves one row per node, combined before the shuffle.
    """
    cuts = Cuts(resolved.sparkSession, "descendants")
    resolved = cuts.cut(resolved)
    deepest = resolved.agg(F.max("depth")).first()[0] or 0
    counts, step = resolved.where("depth >= 0").select("id", F.lit(1).cast("long").alias("n")), 1
    while step <= deepest:
        above = resolved.where(F.col("depth") >= step).select(F.col("id").alias("below"), F.element_at("path", -1 - step).alias("id"))
        more = above.join(counts.select(F.col("id").alias("below"), "n"), "below").groupBy("id").agg(F.sum("n").alias("more"))
        nxt = cuts.cut(counts.join(more, "id", "left").select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        cuts.drop(counts)
        counts, step = nxt, 2 * step
    return resolved.join(counts.select("id", (F.col("n") - 1).alias("n_descendants")), "id", "left")


def check_stored_roots(items: DataFrame, resolved: DataFrame, id_col: str = "id", root_col: str = "root_id") -> DataFrame:
    """Nodes in or below a loop, and nodes whose stored root is not the true one.

    A null stored root means the node itself.  Returns ``id, true_root, depth``.
    """
    stored = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(root_col), F.col(id_col)).cast("long").alias("stored"))
    return resolved.join(stored, "id").where("true_root = -1 or stored <> true_root").select("id", "true_root", "depth")
