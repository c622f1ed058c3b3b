"""Join shapes that the planner does not find by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_fusion(legs: list[tuple[DataFrame, float]], key: str = "id", rank: str = "rank", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ``key, score, legs`` with the sum of ``weight / (k + rank)``, ranks from 1.

    Legs are stacked and summed, which gives what full outer joins of them would, with one shuffle.
    A key that comes twice in a leg counts with its best rank; null keys and ranks are left out.
    """
    out = None
    for i, (leg, weight) in enumerate(legs):
        part = leg.where(F.col(key).isNotNull() & F.col(rank).isNotNull()).groupBy(key).agg(F.min(rank).alias("_r")).select(key, F.lit(i).alias("leg"), (F.lit(float(weight)) / (k + F.col("_r"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("legs"))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges in both directions, so that an OR join becomes an equi-join; loops stay single."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    back = edges.where(F.col(src) != F.col(dst)).select(F.col(dst).alias(src), F.col(src).alias(dst), *rest)
    return edges.select(src, dst, *rest).unionByName(back)


def contains_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int = 256) -> DataFrame:
    """Points joined with the ranges of the same key that hold them, by bins of ``width``.

    A range is entered in every bin it touches, a point in its own, so the join is an equi-join and a
    key with a third of all rows is spread over its bins.  Ranges without start or end match nothing.
    """
    r = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    r = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    return p.join(r, [key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bin")


def innermost(points: DataFrame, ranges: DataFrame, key: str, point_id: str, at: str, start: str, end: str, range_id: str) -> DataFrame:
    """The smallest range around each point (ties: the later start, then the smaller id)."""
    joined = contains_join(points, ranges, key, at, start, end)
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("w"), (-F.col(start)).alias("s"), F.col(range_id).alias("r")))
    return joined.groupBy(point_id).agg(best.alias("b")).select(point_id, F.col("b.r").alias(range_id))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_columns: list[str]) -> DataFrame:
    """Each left row with the right row of the same key that is latest at its time or before (null if none).

    Both sides are stacked and carried forward by one window per key.  Right rows with equal times are
    settled by the greatest columns.  Left rows with a null time get none.
    """
    packed = F.struct(*right_columns)
    l = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_r": F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType)})
    lcols = [c for c in left.columns if c not in keys]
    r = right.where(F.col(right_time).isNotNull()).select(*keys, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"))
    both = l.select(*keys, *lcols, "_t", "_side", "_r").unionByName(r)
    w = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select(*keys, *lcols, *[F.col(f"_last.{c}").alias(c) for c in right_columns])


def first_match(rows: DataFrame, key: str, phases: list[tuple[DataFrame, list, str]], result: str = "target") -> DataFrame:
    """Name resolution in phases: the first phase that finds a target wins, later ones see only the rest.

    Each phase is ``(candidates, join columns, target column)``; of several targets in one phase the
    smallest is taken.  Rows that no phase resolves have a null target and phase.
    """
    out = rows.withColumns({result: F.lit(None).cast("string"), "phase": F.lit(None).cast("int")})
    for i, (cand, on, target) in enumerate(phases):
        best = cand.groupBy(*on).agg(F.min(F.col(target).cast("string")).alias("_t"))
        out = out.join(best, on, "left").withColumns({"phase": F.when(F.col(result).isNull() & F.col("_t").isNotNull(), F.lit(i)).otherwise(F.col("phase")), result: F.coalesce(result, "_t")}).drop("_t")
    return out


def drop_worktree_copies(files: DataFrame, project: str = "project_id", repo: str = "repo", path: str = "relative_path") -> DataFrame:
    """Files without those that a project of the same repository with a smaller id has at the same path.

    Projects without a repository (null) are kept whole.
    """
    least = files.where(F.col(repo).isNotNull()).groupBy(repo, path).agg(F.min(project).alias("_first"))
    return files.join(least, [repo, path], "left").where(F.col("_first").isNull() | (F.col(project) == F.col("_first"))).drop("_first").select(files.columns)
