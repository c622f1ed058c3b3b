"""Queries about the hierarchy of work items, and the SQL to compare them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import check_stored_roots, descendants, resolve_hierarchy, with_descendant_counts
from ..sources.tables import latest, table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "work_items", "id", "parent_id", "root_id", "updated_at"), "id", "updated_at")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items in or below a loop, and items whose stored root is wrong."""
    items = _items(spark, folder)
    return check_stored_roots(items, resolve_hierarchy(items, with_path=False))


def p4_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with its root, depth, path from the root and number of descendants."""
    r = with_descendant_counts(resolve_hierarchy(_items(spark, folder)))
    return r.select("id", "true_root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "n_descendants")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of an item and one below it, with the distance."""
    return descendants(resolve_hierarchy(_items(spark, folder)))


_TREE = """
WITH RECURSIVE cur AS (
  SELECT id, parent_id, root_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_id DESC, root_id DESC) rn FROM work_items WHERE id IS NOT NULL) WHERE rn = 1),
tree(id, true_root, depth, path) AS (
  SELECT id, id, 0, CAST(id AS VARCHAR) FROM cur WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM cur)
  UNION ALL
  SELECT c.id, t.true_root, t.depth + 1, t.path || '/' || CAST(c.id AS VARCHAR) FROM tree t JOIN cur c ON c.parent_id = t.id),
full_tree AS (
  SELECT c.id, coalesce(t.true_root, -1) AS true_root, coalesce(t.depth, -1) AS depth, t.path, c.root_id FROM cur c LEFT JOIN tree t USING (id)),
below(ancestor, descendant, distance) AS (
  SELECT c.parent_id, c.id, 1 FROM cur c JOIN tree t USING (id) WHERE t.depth > 0
  UNION ALL
  SELECT c.parent_id, b.descendant, b.distance + 1 FROM below b JOIN cur c ON c.id = b.ancestor JOIN tree t ON t.id = c.id WHERE t.depth > 0)
"""

QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}
SQL = {
    "p4_found": _TREE + "SELECT id, CAST(true_root AS BIGINT) AS true_root, CAST(depth AS INTEGER) AS depth FROM full_tree WHERE true_root = -1 OR coalesce(root_id, id) <> true_root",
    "p4_hierarchy": _TREE
    + """SELECT f.id, CAST(f.true_root AS BIGINT) AS true_root, CAST(f.depth AS INTEGER) AS depth, f.path,
       CASE WHEN f.depth >= 0 THEN coalesce(n.n, 0) END AS n_descendants
       FROM full_tree f LEFT JOIN (SELECT ancestor, count(*) n FROM below GROUP BY ancestor) n ON n.ancestor = f.id""",
    "p4_descendants": _TREE + "SELECT ancestor, descendant, CAST(distance AS INTEGER) AS distance FROM below",
}
