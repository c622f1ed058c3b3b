"""Vector expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, v) -> s + v)")


def norm(a: str) -> Column:
    """Euclidean length of an array column."""
    return F.expr(f"sqrt(aggregate({a}, 0D, (s, v) -> s + cast(v as double) * v))")


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_to(a: str, query: list[float]) -> Column:
    """Cosine of an array column to a constant vector; null for zero or another width."""
    q = "array(" + ", ".join(f"{float(x)!r}D" for x in query) + ")"
    qn = sum(x * x for x in query) ** 0.5
    d = F.expr(f"aggregate(zip_with({a}, {q}, (x, y) -> cast(x as double) * y), 0D, (s, v) -> s + v)")
    n = norm(a) * F.lit(qn)
    return F.when((F.size(a) == len(query)) & (n > 0), d / n)


def unit(a: str) -> Column:
    """The array scaled to length one; null for a zero vector."""
    return F.when(norm(a) > 0, F.expr(f"transform({a}, v -> cast(v as double) / sqrt(aggregate({a}, 0D, (s, w) -> s + cast(w as double) * w)))"))
