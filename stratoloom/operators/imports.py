"""Imports resolved to files, and the file graph that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file is found by up to so many of the last parts of its path.
MOST_PARTS = 8


def _module_path(path) -> F.Column:
    """A file's path as modules name it: no extension, and a directory's own file stands for the directory."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(p, r"/(?:__init__|index|mod|lib|main)$", "")


def resolve_imports(imports: DataFrame, files: DataFrame, id_col: str = "file_id", project: str = "project_id", path: str = "relative_path") -> DataFrame:
    """``src, dst, target``: the file that each import of :func:`text.extract_imports` (id, target) leads to.

    A target is tried in this order: relative to the importing file's directory (``./``, ``../`` and
    leading points), as the last parts of a path in the same project, and so without its last part,
    which may be a name within the module.  The first that fits counts, of several files the
    one with the shortest path, then the smallest id; what fits no file (libraries) gives no row.
    Null paths and projects fit nothing; a file that imports itself gives no row.
    """
    f = files.where(F.col(id_col).isNotNull() & F.col(project).isNotNull() & F.col(path).isNotNull()).groupBy(F.col(id_col).alias("f")).agg(F.max(F.struct(F.col(project).alias("p"), F.col(path).alias("path"))).alias("r"))
    f = f.select("f", "r.p", _module_path(F.col("r.path")).alias("module"), F.regexp_replace("r.path", r"/?[^/]*$", "").alias("dir"))
    parts = F.split("module", "/")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(MOST_PARTS))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))
    known = f.select("p", "f", F.length("module").alias("n"), F.explode(ends).alias("key")).groupBy("p", "key").agg(F.min(F.struct("n", "f")).alias("best")).select("p", "key", F.col("best.f").alias("dst"))
    exact = f.groupBy("p", F.col("module").alias("key")).agg(F.min("f").alias("dst"))
    # points and colons part modules, a leading point is the own directory, each further one its parent
    t = F.regexp_replace(F.regexp_replace("target", r"^(?:crate|self|super)::", ""), "::", "/")
    dotted = ~F.col("target").contains("/") & ~F.col("target").startswith(".")
    t = F.when(dotted, F.regexp_replace(t, r"\.", "/")).otherwise(F.regexp_replace(t, r"\.(?:m?jsx?|tsx?|py|json)$", ""))
    i = imports.select(F.col("id").alias("f"), "target", t.alias("t")).distinct().join(f.select("f", "p", "dir"), "f")
    ups = F.length(F.regexp_extract("t", r"^((?:\.\./)+)", 1)) / 3
    here = F.split("dir", "/")
    up = F.greatest(F.size(here) - ups.cast("int"), F.lit(0))
    base = F.array_join(F.slice(here, F.lit(1), up), "/")
    rest = F.regexp_replace("t", r"^(?:\.\.?/)+", "")
    relative = F.when(F.col("t").startswith("."), F.concat_ws("/", F.when(base != "", base), rest))
    shorter = F.regexp_replace("t", r"/[^/]*$", "")
    i = i.withColumns({"k0": relative, "k1": F.when(~F.col("t").startswith("."), F.col("t")), "k2": F.when(F.col("t").contains("/") & ~F.col("t").startswith("."), shorter)})
    found = None
    for phase, (key, table) in enumerate((("k0", exact), ("k1", known), ("k2", known))):
        part = i.where(F.col(key).isNotNull()).select("p", F.col("f").alias("src"), "target", F.col(key).alias("key")).join(table, ["p", "key"]).select("src", "target", F.struct(F.lit(phase).alias("phase"), "dst").alias("hit"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("src", "target").agg(F.min("hit").alias("hit")).select("src", F.col("hit.dst").alias("dst"), "target").where("src <> dst")
