"""Point-in-time views of facts, unified edges and paths that fade with age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import valid_at


def facts_at(facts: DataFrame, at, known_at=None, start: str = "valid_from", end: str = "valid_to", recorded: str | None = None, superseded: str | None = None) -> DataFrame:
    """Facts that hold at a moment; with ``known_at`` only those recorded by then and not yet superseded."""
    out = facts.where(valid_at(at, start, end))
    if known_at is not None and recorded:
        out = out.where(F.coalesce(F.col(recorded) <= F.lit(known_at), F.lit(False)))
        if superseded:
            out = out.where(F.col(superseded).isNull() | (F.col(superseded) > F.lit(known_at)))
    return out


def unified_edges(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One edge table from typed ones: ``src, dst, kind, weight, open``.

    Each part is ``(edges, kind, source type, target type)`` with ``src, dst, weight`` and perhaps ``valid_to``;
    ends become ``type:id``.  Of equal edges the greatest weight counts, and the edge is open if any is.
    """
    out = None
    for e, kind, a, b in parts:
        is_open = F.col("valid_to").isNull() if "valid_to" in e.columns else F.lit(True)
        p = e.where("src is not null and dst is not null").select(F.concat(F.lit(a + ":"), F.col("src").cast("string")).alias("src"), F.concat(F.lit(b + ":"), F.col("dst").cast("string")).alias("dst"), F.lit(kind).alias("kind"), F.col("weight").cast("double").alias("weight"), is_open.alias("open"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"), F.bool_or("open").alias("open"))


def aged(weight, age_days, half_life: float):
    """A weight halved once per half-life; without an age it stays."""
    return F.when(age_days.isNull(), weight).otherwise(weight * F.exp(-F.log(F.lit(2.0)) * age_days / half_life))


def recency(age_days, half_life: float):
    """0.5 to the power of age over half-life."""
    return F.pow(F.lit(0.5), age_days / half_life)


def merge_legs(dense: DataFrame, sparse: DataFrame, key: str, similarity: str = "sim", rank: str = "rank", k: int = 60) -> DataFrame:
    """Two ranked legs fused by key: ``key, score, sim``; a row that both legs found is one row."""
    parts = dense.select(key, rank, similarity).unionByName(sparse.select(key, rank, F.lit(None).cast("double").alias(similarity)))
    return parts.groupBy(key).agg(F.sum(1 / (F.lit(float(k)) + F.col(rank))).alias("score"), F.max(similarity).alias(similarity))


def supersede_loops(rows: DataFrame, id_col: str, by_col: str) -> DataFrame:
    """Ids that superseding links lead round in a loop, or into one: ``id``."""
    from .hierarchy import resolve_hierarchy

    return resolve_hierarchy(rows, id_col, by_col, with_path=False).where("true_root = -1").select("id")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Pairs of facts of one key whose intervals overlap, with the shared interval ``from_, to_`` (null: open)."""
    left = a.select(*keys, F.col(start).alias("_s1"), F.col(end).alias("_e1"), *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in (*keys, start, end)])
    right = b.select(*keys, F.col(start).alias("_s2"), F.col(end).alias("_e2"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in (*keys, start, end)])
    j = left.join(right, keys).where((F.col("_e1").isNull() | (F.col("_s2") < F.col("_e1"))) & (F.col("_e2").isNull() | (F.col("_s1") < F.col("_e2"))))
    return j.withColumns({"from_": F.greatest("_s1", "_s2"), "to_": F.least("_e1", "_e2")}).drop("_s1", "_e1", "_s2", "_e2")
