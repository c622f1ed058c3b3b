"""Collectors of code findings per file, the scores of the pillars over them, and gaps in tests and use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each collector looks for, by its pillar.
FINDINGS = {
    "wildcard_import": ("hygiene", r"(?m)^[ \t]*(?:from[ \t]+[\w.]+[ \t]+import[ \t]+\*|import[ \t]+[\w.]+\.\*;|(?:pub[ \t]+)?use[ \t]+[\w:]+::\*;)"),
    "deep_relative_import": ("hygiene", r"['\"](?:\.\./){3,}[\w./-]+['\"]"),
    "marker": ("hygiene", r"\b(?:TODO|FIXME|HACK|XXX)\b"),
    "merge_mark": ("hygiene", r"(?m)^(?:<<<<<<<|>>>>>>>) "),
    "swallowed_error": ("hygiene", r"except[^:\n]*:\s*pass\b|catch\s*\([^)]*\)\s*\{\s*\}"),
    "dynamic_code": ("security", r"\b(?:eval|exec)\s*\("),
    "shell_command": ("security", r"\bos\.system\s*\(|shell\s*=\s*True|\bchild_process\b|Runtime\.getRuntime\(\)\.exec"),
    "built_sql": ("security", r"(?i)\bexecute\w*\s*\(\s*(?:f['\"]|['\"][^'\"\n]*['\"]\s*(?:\+|%))"),
    "weak_hash": ("security", r"(?i)\b(?:md5|sha1)\b\s*[(:.]"),
    "weak_cipher": ("security", r"\b(?:DES|RC4|ECB)\b"),
    "mail_address": ("privacy", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}\b"),
    "card_number": ("privacy", r"\b(?:\d{4}[ -]){3}\d{4}\b"),
    "network_address": ("privacy", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
}
#: What a path of a test looks like, lower case.
TEST_PATH = r"(?:^|/)(?:tests?|specs?|__tests__)/|(?:^|/)test_[^/]*$|[._-](?:test|spec)\.[a-z]+$|_test\.[a-z]+$|tests?\.java$"


def pattern_findings(files: DataFrame, id_col: str = "file_id", content: str = "content") -> DataFrame:
    """``id, collector, pillar, hits`` for every file and collector with at least one hit; null texts have none.

    One pass over the texts, inside the JVM.
    """
    counts = F.array(*[F.struct(F.lit(name).alias("collector"), F.lit(pillar).alias("pillar"), F.size(F.regexp_extract_all(F.col(content), F.lit(p), F.lit(0))).alias("hits")) for name, (pillar, p) in FINDINGS.items()])
    f = files.where(F.col(content).isNotNull()).select(F.col(id_col).alias("id"), F.filter(counts, lambda x: x["hits"] > 0).alias("found"))
    return f.select("id", F.explode_outer("found").alias("x")).where("x is not null").select("id", "x.collector", "x.pillar", "x.hits")


def pillar_scores(files: DataFrame, id_col: str = "file_id", content: str = "content") -> DataFrame:
    """``pillar, collector, score``: 100 times the share of the files with a text in which a collector finds nothing."""
    n = files.where(F.col(content).isNotNull()).agg(F.count(F.lit(1)).alias("files"))
    hit = pattern_findings(files, id_col, content).groupBy("collector").agg(F.count(F.lit(1)).alias("hit"))
    names = files.sparkSession.createDataFrame([(p, c) for c, (p, _) in FINDINGS.items()], "pillar string, collector string")
    # one row for each collector, one row of files
    j = names.join(hit, "collector", "left").crossJoin(n)
    return j.select("pillar", "collector", F.when(F.col("files") > 0, 100.0 * (1 - F.coalesce("hit", F.lit(0)) / F.col("files"))).otherwise(100.0).alias("score"))


def is_test(path) -> F.Column:
    return F.lower(path).rlike(TEST_PATH)


def untested_files(files: DataFrame, id_col: str = "file_id", project: str = "project_id", path: str = "relative_path") -> DataFrame:
    """``id, project_id``: source files that no test of their project is named after (the name without what marks a test).

    Rows with a null path or project are left out.
    """
    f = files.where(F.col(path).isNotNull() & F.col(project).isNotNull()).select(F.col(id_col).alias("id"), F.col(project).alias("project_id"), F.lower(path).alias("path")).distinct()
    name = F.regexp_extract("path", r"([^/]+?)\.[^/.]*$", 1)
    bare = F.regexp_replace(F.regexp_replace(name, r"^tests?_", ""), r"(?:[._-](?:test|spec)|tests?)$", "")
    f = f.withColumns({"test": is_test(F.col("path")), "bare": bare})
    tested = f.where("test").select("project_id", "bare").distinct()
    return f.where("not test and bare <> ''").join(tested, ["project_id", "bare"], "left_anti").select("id", "project_id")


def unused_functions(symbols: DataFrame, files: DataFrame, id_col: str = "file_id", project: str = "project_id") -> DataFrame:
    """``file_id, name, lines``: functions whose short name no call in their project has.

    ``main``, names that begin with ``test`` or ``__`` count as used; what is called through a table or
    by reflection cannot be seen.  ``symbols`` is the result of :func:`symbols.extract_symbols`.
    """
    f = files.select(F.col(id_col).alias("file_id"), F.col(project).alias("project_id")).distinct()
    s = symbols.join(f, "file_id").withColumn("short", F.element_at(F.split("name", r"\."), -1))
    used = s.where("what = 'ref'").select("project_id", "short").distinct()
    defs = s.where("what = 'def' and kind = 'function' and short <> 'main' and not startswith(short, 'test') and not startswith(short, '__')")
    unused = defs.join(used, [defs.project_id.eqNullSafe(used.project_id), defs.short == used.short], "left_anti")
    return unused.select("file_id", "name", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))


def orphan_files(edges: DataFrame, files: DataFrame, id_col: str = "file_id", path: str = "relative_path") -> DataFrame:
    """``id``: files, tests aside, that no other file imports and that import none (edges ``src, dst``)."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return files.where(F.col(path).isNotNull() & ~is_test(F.col(path))).select(F.col(id_col).alias("id")).distinct().join(ends, "id", "left_anti")
