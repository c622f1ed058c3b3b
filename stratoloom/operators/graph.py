"""Graph operators as DataFrame loops over an edge list."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts
from .graph_blocks import block_graph


def _kept_by(edges: DataFrame, key: str) -> DataFrame:
    """Edges of a cut kept on the executors' disks by their key, so that in the rounds of a loop only the nodes' values move.

    What an executor loses is read again from the cut.
    """
    return edges.repartition(key).persist(StorageLevel.DISK_ONLY)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component`` for every node of an undirected edge list; the component's smallest node.

    Alternates large-star and small-star steps: every step is one aggregation and one join over the
    edges, combined before the shuffle, and the number of steps grows with the logarithm of the
    number of nodes.  Edges with a null end are dropped; loops make their node a component of its own.
    """
    cuts = Cuts(edges.sparkSession, "components")
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("v"), F.least(src, dst).alias("u"))
    nodes = cuts.cut(e.select(F.col("v").alias("id")).union(e.select("u")).distinct())
    cur = cuts.cut(e.where("u < v").distinct())
    last = None
    while True:
        # large star: every neighbour that is larger is linked to the least neighbour
        both = cur.unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: the node and its smaller neighbours are linked to the least of them
        l2 = cuts.cut(large.where("u < v").distinct())
        m2 = l2.groupBy("v").agg(F.min("u").alias("m"))
        small = l2.join(m2, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(m2.select("v", F.col("m").alias("u")))
        nxt = cuts.cut(small.where("u < v").distinct())
        sign = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        cuts.drop(cur)
        cuts.drop(l2)
        cur = nxt
        if last == (sign.n, sign.s):
            break
        last = (sign.n, sign.s)
    least = cur.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return nodes.join(least, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def edge_list(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """``src, dst, w``: parallel edges summed (counted without a weight), null ends dropped."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(w.cast("double").alias("w"))


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, in_degree, out_degree``; parallel edges count each."""
    ends = edges.where(F.col(src).isNotNull()).select(F.col(src).alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.where(F.col(dst).isNotNull()).select(F.col(dst).alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-8, seeds: list | None = None) -> DataFrame:
    """``id, rank``; edges as from :func:`edge_list`.

    ``PR(v) = (1 - d) s(v) + d (sum PR(u) w / out(u) + dangling s(v))`` with s uniform, or uniform on the
    seeds (personalised).  Stops when no rank moves by more than the tolerance.  Every iteration is one
    join and one pre-combined aggregation; only the dangling mass and the greatest change reach the driver.
    """
    cuts = Cuts(edges.sparkSession, "pagerank")
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    e = _kept_by(cuts.cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p"))), "src")
    nodes = _nodes(edges)
    start = F.col("id").isin(seeds) if seeds is not None else F.lit(True)
    nodes = cuts.cut(nodes.join(out.select(F.col("src").alias("id"), F.lit(True).alias("has_out")), "id", "left").select("id", F.coalesce("has_out", F.lit(False)).alias("has_out"), start.alias("seed")))
    n = nodes.where("seed").count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    base = F.when(F.col("seed"), 1.0 / n).otherwise(0.0)
    ranks = cuts.cut(nodes.select("id", base.alias("rank"), "has_out", "seed"))
    for _ in range(iterations):
        dangling = ranks.where(~F.col("has_out")).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d")).first().d
        inflow = e.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("x"))
        new = ranks.join(inflow, "id", "left").select(
            "id", ((1 - damping) * base + damping * (F.coalesce("x", F.lit(0.0)) + dangling * base)).alias("rank"), "has_out", "seed", F.col("rank").alias("old")
        )
        nxt = cuts.cut(new)
        moved = nxt.agg(F.max(F.abs(F.col("rank") - F.col("old"))).alias("m")).first().m if tolerance > 0 else 1.0
        cuts.drop(ranks)
        ranks = nxt
        if moved <= tolerance:
            break
    e.unpersist()
    return ranks.select("id", "rank")


def spreading_rank(edges: DataFrame, seeds: list, keep: float = 0.85, iterations: int = 25) -> DataFrame:
    """Personalised rank over undirected weighted edges, as graph retrieval uses it: ``id, rank``.

    ``PR(v) = keep * sum PR(u) w / sum w(u) + (1 - keep) r(v)`` with r uniform on the seeds, a fixed number
    of rounds, no dangling term; row sums are at least 1e-12.
    """
    cuts = Cuts(edges.sparkSession, "spread")
    both = edges.select("src", "dst", "w").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    total = both.groupBy("src").agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("t"))
    e = _kept_by(cuts.cut(both.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))), "src")
    r = F.when(F.col("id").isin(seeds), 1.0 / len(seeds)).otherwise(0.0)
    nodes = cuts.cut(_nodes(edges))
    ranks = cuts.cut(nodes.select("id", r.alias("rank")))
    for _ in range(iterations):
        inflow = e.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("x"))
        nxt = cuts.cut(nodes.join(inflow, "id", "left").select("id", (keep * F.coalesce("x", F.lit(0.0)) + (1 - keep) * r).alias("rank")))
        cuts.drop(ranks)
        ranks = nxt
    e.unpersist()
    return ranks


def hits(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """``id, authority, hub``: authority sums the hubs of the sources, hub the new authorities of the targets,
    each scaled to length 1 per round; starts at 1; parallel edges count by weight."""
    cuts = Cuts(edges.sparkSession, "hits")
    edges = cuts.cut(edges)
    by_src, by_dst = _kept_by(edges, "src"), _kept_by(edges, "dst")
    nodes = cuts.cut(_nodes(edges))
    hub = cuts.cut(nodes.select("id", F.lit(1.0).alias("h")))
    auth = None

    def scaled(df: DataFrame, c: str) -> DataFrame:
        raw = cuts.cut(df)
        length = raw.agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias("s")).first().s or 1.0
        out = cuts.cut(raw.withColumn(c, F.col(c) / length))
        cuts.drop(raw)
        return out

    for _ in range(iterations):
        before, last = auth, hub
        a = by_src.join(hub.select(F.col("id").alias("src"), "h"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("h")).alias("a"))
        auth = scaled(nodes.join(a, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a")), "a")
        h = by_dst.join(auth.select(F.col("id").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("a")).alias("h"))
        hub = scaled(nodes.join(h, "id", "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h")), "h")
        cuts.drop(before)
        cuts.drop(last)
    by_src.unpersist()
    by_dst.unpersist()
    return auth.join(hub, "id").select("id", F.col("a").alias("authority"), F.col("h").alias("hub"))


def bfs(edges: DataFrame, sources: list, depth: int) -> DataFrame:
    """``id, hops`` of the nodes within ``depth`` steps along the edges; sources have 0."""
    spark = edges.sparkSession
    cuts = Cuts(spark, "bfs")
    e = cuts.cut(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType.simpleString()
    seen = cuts.cut(spark.createDataFrame([(s,) for s in sources], f"id {kind}").withColumn("hops", F.lit(0)))
    frontier = seen
    for h in range(1, depth + 1):
        new = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(h))
        frontier = cuts.cut(new)
        if frontier.isEmpty():
            break
        seen = cuts.cut(seen.unionByName(frontier))
    return seen


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All ``src, dst, hops`` with a path of at least one edge, hops the fewest edges of one.

    The reach doubles per round: a shortest path of more than h and at most 2h edges is one of exactly h
    edges, found in the last round, and a shorter one.  Only those are joined; the rounds grow with the
    logarithm of the longest shortest path, and loops end because every pair is kept once.
    """
    cuts = Cuts(edges.sparkSession, "closure")
    done = cuts.cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("hops", F.lit(1)))
    reach = 1
    while True:
        heads = done.where(F.col("hops") == reach).select("src", F.col("dst").alias("mid"))
        tails = done.select(F.col("src").alias("mid"), "dst", "hops")
        step = heads.join(tails, "mid").groupBy("src", "dst").agg((F.min("hops") + reach).alias("hops"))
        new = cuts.cut(step.join(done.select("src", "dst"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return done
        done = cuts.cut(done.unionByName(new))
        reach *= 2


def simple_paths(edges: DataFrame, sources: list, hops: int, half_life_days: float | None = None) -> DataFrame:
    """Paths without repeated nodes from the sources: ``path, hops, weight``.

    The weight is the product of the edge weights, each halved per ``half_life_days`` of its ``age_days`` if
    the edges have that column.  The number of paths is the result; keep ``hops`` small.
    """
    w = F.col("w")
    if half_life_days and "age_days" in edges.columns:
        w = w * F.when(F.col("age_days").isNotNull(), F.exp(-F.log(F.lit(2.0)) * F.col("age_days") / half_life_days)).otherwise(1.0)
    e = edges.select(F.col("src").alias("last"), F.col("dst").alias("nxt"), w.alias("ew"))
    paths = e.where(F.col("last").isin(sources) & (F.col("last") != F.col("nxt"))).select(F.array("last", "nxt").alias("path"), F.lit(1).alias("hops"), F.col("ew").alias("weight"))
    out, cur = paths, paths
    for h in range(2, hops + 1):
        cur = cur.withColumn("last", F.element_at("path", -1)).join(e, "last").where(~F.array_contains("path", F.col("nxt"))).select(F.concat("path", F.array("nxt")).alias("path"), F.lit(h).alias("hops"), (F.col("weight") * F.col("ew")).alias("weight"))
        out = out.unionByName(cur)
    return out


def ranked_paths(edges: DataFrame, seeds: DataFrame, hops: int, min_flow: float, k: int) -> DataFrame:
    """The ``k`` strongest paths without repeated nodes from the ``seeds`` (id, w): ``path, hops, flow, rank``.

    The flow is the seed's weight times the edge weights, each 1 where it is not positive and finite; a
    path is dropped where its flow falls below ``min_flow``, and goes no further.  Ties go to the
    shorter path, then to the smaller nodes.
    """
    sound = lambda c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c)).otherwise(F.lit(1.0))
    cuts = Cuts(edges.sparkSession, "ranked-paths")
    e = edges.select(F.col("src").alias("last"), F.col("dst").alias("nxt"), sound("w").cast("double").alias("ew"))
    cur = seeds.select(F.array("id").alias("path"), F.lit(0).alias("hops"), sound("w").cast("double").alias("flow"))
    out = None
    for h in range(1, max(hops, 1) + 1):
        step = cur.withColumn("last", F.element_at("path", -1)).join(e, "last").where(~F.array_contains("path", F.col("nxt")))
        cur = cuts.cut(step.select(F.concat("path", F.array("nxt")).alias("path"), F.lit(h).alias("hops"), (F.col("flow") * F.col("ew")).alias("flow")).where(F.col("flow") >= min_flow))
        out = cur if out is None else out.unionByName(cur)
    order = [F.desc("flow"), F.col("hops"), F.col("path")]
    # at most k rows
    return out.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest node) of the strongly connected components.

    Nodes that cannot lie on a cycle are peeled off; the others are coloured by the smallest node that
    reaches them, and what reaches that node within its colour is a component.  Repeats on what is left.
    """
    cuts = Cuts(edges.sparkSession, "scc")
    e = cuts.cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = cuts.cut(_nodes(e))
    found = None
    live = cuts.cut(e.where("src <> dst"))
    while True:
        # peel nodes without an edge in or out
        n = live.count()
        while n:
            both = live.select(F.col("src").alias("id")).distinct().intersect(live.select(F.col("dst").alias("id")).distinct())
            trimmed = cuts.cut(live.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi"))
            m = trimmed.count()
            live = trimmed
            if m == n:
                break
            n = m
        if not n:
            break
        colour = cuts.cut(_nodes(live).withColumn("c", F.col("id")))
        while True:
            msg = live.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            nxt = cuts.cut(colour.join(msg, "id", "left").select("id", F.least("c", "m").alias("c"), F.col("c").alias("old")))
            changed = nxt.where("c <> old").isEmpty()
            colour = nxt.select("id", "c")
            if changed:
                break
        within = live.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        within = cuts.cut(within)
        reach = cuts.cut(colour.where("id = c").select("id", "c"))
        frontier = reach
        while True:
            back = within.join(frontier.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            frontier = cuts.cut(back.join(reach, ["id", "c"], "left_anti"))
            if frontier.isEmpty():
                break
            reach = cuts.cut(reach.unionByName(frontier))
        found = reach if found is None else found.unionByName(reach)
        gone = reach.select("id")
        live = cuts.cut(live.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if found is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def k_core(edges: DataFrame) -> DataFrame:
    """``id, core``: the greatest k such that the node is in a subgraph of degrees k and more (undirected, simple).

    Within blocks of neighbour lists every node's bound falls from its degree to its core (:mod:`graph_blocks`).  In a
    graph that is none for blocks every round takes away all nodes below the current k at once.
    """
    cuts = Cuts(edges.sparkSession, "kcore")
    whole = edges.where("src is not null and dst is not null").select("src", "dst")
    ids = cuts.cut(_nodes(whole))
    graph = block_graph(whole, ids, cuts)
    if graph:
        return graph.table(graph.cores(), "core", "int")
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    live = cuts.cut(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(e.select("b", "a")))
    nodes, out, k = ids, None, 1
    while True:
        deg = live.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
        low = deg.agg(F.min("d").alias("m")).first().m
        if low is None:
            break
        k = max(k, low)
        gone = cuts.cut(deg.where(F.col("d") <= k).select(F.col("src").alias("id")))
        part = gone.withColumn("core", F.lit(k))
        out = part if out is None else out.unionByName(part)
        nxt = cuts.cut(live.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))
        # neighbours that lost their last edge leave with this core as well
        left = live.select(F.col("src").alias("id")).distinct().join(gone, "id", "left_anti").join(nxt.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        out = out.unionByName(cuts.cut(left).withColumn("core", F.lit(k)))
        live = nxt
    if out is None:
        return nodes.withColumn("core", F.lit(0))
    return nodes.join(out, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"))


def triangles(edges: DataFrame) -> DataFrame:
    """``id, triangles, degree`` in the simple undirected graph.

    Each edge points from the end with the smaller degree to the other, so a hub with a third of all
    edges has few outgoing ones and no node pairs all its neighbours.
    """
    cuts = Cuts(edges.sparkSession, "triangles")
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = cuts.cut(e)
    deg = cuts.cut(e.select(F.col("a").alias("id")).union(e.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    r = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = cuts.cut(r.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = o.join(o.select("u", F.col("v").alias("w")), "u").where("v < w")
    tri = wedges.join(e.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    n = tri.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return deg.join(n, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.col("d").alias("degree"))


def wl_labels(edges: DataFrame, rounds: int = 2, label: DataFrame | None = None) -> DataFrame:
    """Weisfeiler-Lehman labels: ``id, label``; two nodes agree if their neighbourhoods do for so many rounds.

    A round hashes the own label with the sums of hashes of the out- and in-neighbours' labels, which are
    combined before the shuffle however many neighbours there are.  Starts from ``label`` (id, label) or equal ones.
    """
    cuts = Cuts(edges.sparkSession, "wl")
    e = cuts.cut(edges.where("src is not null and dst is not null").select("src", "dst"))
    cur = label if label is not None else _nodes(e).withColumn("label", F.lit(0).cast("long"))
    cur = cuts.cut(cur.select("id", F.col("label").cast("long").alias("label")))
    for _ in range(rounds):
        h = F.xxhash64("label").cast("decimal(38,0)")
        out = e.join(cur.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(h).alias("o"), F.count(F.lit(1)).alias("no"))
        inn = e.join(cur.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(h).alias("i"), F.count(F.lit(1)).alias("ni"))
        cur = cuts.cut(cur.join(out, "id", "left").join(inn, "id", "left").select("id", F.xxhash64("label", "o", "no", "i", "ni").alias("label")))
    return cur


def harmonic_centrality(edges: DataFrame, sources: DataFrame | None = None, most_hops: int = 64) -> DataFrame:
    """``id, harmonic``: the sum of 1 / distance to all other nodes over n - 1 (undirected), for the given
    ``sources`` (id) or all nodes.

    For all nodes the searches go on as bits within the workers, component by component (:mod:`graph_blocks`).  For
    given sources, or a graph that is none for blocks, one breadth-first search for all sources together: the
    frontier is (source, node) pairs.
    """
    cuts = Cuts(edges.sparkSession, "harmonic")
    e = edges.where("src is not null and dst is not null").select("src", "dst")
    if sources is None:
        cuts.sweep()
        nodes = cuts.cut(_nodes(e))
        graph = block_graph(e, nodes, cuts)
        if graph:
            cuts.sweep()
            total = graph.harmonic(most_hops)
            return nodes.join(total, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) / max(graph.n - 1, 1)).alias("harmonic"))
    both = cuts.cut(e.union(e.select("dst", "src")).distinct())
    nodes = cuts.cut(_nodes(both))
    n = nodes.count()
    frontier = cuts.cut((sources.select("id") if sources is not None else nodes).select(F.col("id").alias("s"), F.col("id").alias("v")))
    seen, sums = frontier, None
    for h in range(1, most_hops + 1):
        nxt = frontier.join(both, F.col("v") == F.col("src")).select("s", F.col("dst").alias("v")).distinct().join(seen, ["s", "v"], "left_anti")
        frontier = cuts.cut(nxt)
        part = frontier.groupBy("s").agg((F.count(F.lit(1)) / F.lit(float(h))).alias("x"))
        sums = part if sums is None else sums.unionByName(part)
        if frontier.isEmpty():
            break
        seen = cuts.cut(seen.unionByName(frontier))
    start = sources.select("id") if sources is not None else nodes
    total = sums.groupBy("s").agg(F.sum("x").alias("x"))
    return start.join(total, F.col("id") == F.col("s"), "left").select("id", (F.coalesce("x", F.lit(0.0)) / max(n - 1, 1)).alias("harmonic"))


def module_metrics(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """``module, ca, ce, instability``: distinct outside files with an edge into, and out of, each module.

    ``modules`` has ``id, module``; edges within a module do not count; instability is Ce / (Ca + Ce), 0 without edges.
    """
    m = modules.select("id", "module").distinct()
    e = edges.select("src", "dst").distinct().join(m.select(F.col("id").alias("src"), F.col("module").alias("ms")), "src").join(m.select(F.col("id").alias("dst"), F.col("module").alias("md")), "dst").where("ms <> md")
    ca = e.groupBy(F.col("md").alias("module")).agg(F.countDistinct("src").alias("ca"))
    ce = e.groupBy(F.col("ms").alias("module")).agg(F.countDistinct("dst").alias("ce"))
    out = m.select("module").distinct().join(ca, "module", "left").join(ce, "module", "left").select("module", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return out.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(F.lit(0.0)))


def main_sequence(metrics: DataFrame, types: DataFrame) -> DataFrame:
    """``module, abstractness, instability, distance``: how far modules lie from the line on which the two sum to 1.

    ``metrics`` is the result of :func:`module_metrics`, ``types`` has ``module, abstract, total`` (types that
    only promise and all types); a module without types has an abstractness of 0.
    """
    a = F.coalesce(F.try_divide("abstract", "total"), F.lit(0.0))
    j = metrics.join(types.select("module", F.col("abstract").cast("double").alias("abstract"), "total"), "module", "left").withColumn("abstractness", a)
    return j.select("module", "abstractness", "instability", F.abs(F.col("abstractness") + F.col("instability") - 1).alias("distance"))


def motif_census(edges: DataFrame) -> DataFrame:
    """Counts of connected patterns of three nodes in the simple directed graph: ``motif, n``.

    ``chain`` a->b->c, ``fan_out`` a->b and a->c, ``fan_in``, ``cycle`` a->b->c->a, ``feed_forward`` a->b, b->c, a->c;
    occurrences as subgraphs.  Chains and fans follow from degrees; only the closed ones need joins.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    cuts = Cuts(edges.sparkSession, "motifs")
    e = cuts.cut(e)
    d = degrees(e)
    mutual = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("m"))
    i, o = F.col("in_degree"), F.col("out_degree")
    s = d.agg(F.sum(i * o).alias("c"), F.sum(o * (o - 1) / 2).cast("long").alias("fo"), F.sum(i * (i - 1) / 2).cast("long").alias("fi"))
    # a chain that returns to its start is a mutual pair, not three nodes; both sides are one row
    base = s.crossJoin(F.broadcast(mutual)).select(F.expr("stack(3, 'chain', c - m, 'fan_out', fo, 'fan_in', fi) as (motif, n)"))
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a <> c")
    ff = two.join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("feed_forward").alias("motif"), "n")
    cyc = two.where("a < b and a < c").join(e.select(F.col("src").alias("c"), F.col("dst").alias("a")), ["a", "c"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("cycle").alias("motif"), "n")
    return base.unionByName(ff).unionByName(cyc)
