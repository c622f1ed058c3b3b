"""Readers of files: source trees, JSON lines, transcripts, coverage reports, advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "rs": "rust", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json",
    "jsonl": "jsonl", "md": "markdown", "markdown": "markdown", "txt": "text", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "sql": "sql", "sh": "shell",
}
#: Directories that a scan leaves out.
EXCLUDED = (".git", "node_modules", "target", "dist", "build", "__pycache__", ".venv")


def scan_workspace(spark: SparkSession, root: str, extensions: list[str] | None = None, excluded: tuple[str, ...] = EXCLUDED, most_bytes: int = 10_000_000) -> DataFrame:
    """The source files below a folder: ``path, relative_path, language, size_bytes, modified_at, content, content_hash``.

    Files with other extensions, in excluded directories or over ``most_bytes`` are left out before
    their content is read (the filters reach the scan); bytes that are no UTF-8 are replaced.
    """
    wanted = sorted(extensions or LANGUAGES)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").load(root).where(F.col("length") <= most_bytes)
    base = F.lit(root.rstrip("/") + "/")
    plain = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.expr("substring(plain, length(base) + 1)")
    f = f.withColumns({"plain": plain, "base": base}).withColumn("relative_path", rel)
    for x in excluded:
        f = f.where(~F.concat(F.lit("/"), "relative_path").contains(f"/{x}/"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    lang = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])[ext]
    return f.select(
        F.col("plain").alias("path"), "relative_path", lang.alias("language"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.xxhash64("content").alias("content_hash")
    )


def changed_files(found: DataFrame, known: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """Found files whose content is not known yet under their key."""
    return found.join(known.select(key, digest).distinct(), [key, digest], "left_anti")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that is not blank: ``file, line_number, content``; numbers count all lines from 1."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "content"))
    return t.where(F.trim("content") != "").select("file", (F.col("n") + 1).alias("line_number"), "content")


MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns of agent transcripts in JSON lines: ``file, turn, role, text``.

    Two shapes are understood: ``{"type", "message": {"role", "content"}}`` with content a text or a list
    of parts, and ``{"payload": {"role", "content": [{"text"}]}}``.  Lines of other shapes are left out.
    """
    j = json_lines(spark, path)
    first = lambda *paths: F.coalesce(*[F.get_json_object("content", p) for p in paths])
    role = first("$.message.role", "$.payload.role", "$.role", "$.type")
    parts = first("$.message.content", "$.payload.content", "$.content")
    listed = F.from_json(parts, "array<struct<text:string>>")
    text = F.when(parts.startswith("["), F.array_join(F.filter(F.transform(listed, lambda p: p["text"]), lambda x: x.isNotNull()), "\n")).otherwise(parts)
    return j.select("file", F.col("line_number").alias("turn"), role.alias("role"), text.alias("text")).where("role is not null and text is not null and text <> ''")


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """Line hits of an LCOV report: ``file, line, hits``."""
    rec = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "end_of_record")).alias("r"))
    rec = rec.select(F.trim(F.regexp_extract("r", r"(?m)^SF:(.*)$", 1)).alias("file"), F.explode(F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))).alias("d"))
    s = F.split("d", ",")
    return rec.where("file <> ''").groupBy("file", s[0].cast("int").alias("line")).agg(F.sum(s[1].cast("long")).alias("hits"))


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """Line hits of a Cobertura report: ``file, line, hits``."""
    c = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<class .*?</class>)"), F.lit(1))).alias("c"))
    c = c.select(F.regexp_extract("c", r'filename="([^"]*)"', 1).alias("file"), F.explode(F.regexp_extract_all("c", F.lit(r"<line ([^>]*)>"), F.lit(1))).alias("l"))
    n, h = (F.regexp_extract("l", rf'\b{a}="(\d+)"', 1).try_cast("long") for a in ("number", "hits"))
    return c.groupBy("file", n.cast("int").alias("line")).agg(F.max(h).alias("hits"))


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    """Line hits of a JaCoCo report: ``file, line, hits`` (covered instructions)."""
    p = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<package .*?</package>)"), F.lit(1))).alias("p"))
    p = p.select(F.regexp_extract("p", r'<package name="([^"]*)"', 1).alias("pkg"), F.explode(F.regexp_extract_all("p", F.lit(r"(?s)(<sourcefile .*?</sourcefile>)"), F.lit(1))).alias("s"))
    s = p.select(F.concat_ws("/", F.nullif("pkg", F.lit("")), F.regexp_extract("s", r'name="([^"]*)"', 1)).alias("file"), F.explode(F.regexp_extract_all("s", F.lit(r"<line ([^>]*)/>"), F.lit(1))).alias("l"))
    n, c = (F.regexp_extract("l", rf'\b{a}="(\d+)"', 1).try_cast("long") for a in ("nr", "ci"))
    return s.select("file", n.cast("int").alias("line"), c.alias("hits"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """Line hits of a report of any of the three kinds, told by its beginning."""
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 4000).alias("h")).first()
    text = head.h if head else ""
    return jacoco(spark, path) if "<report" in text else cobertura(spark, path) if "<coverage" in text else lcov(spark, path)


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories in the OSV format: ``id, ecosystem, package, introduced, fixed``, one row per range event pair."""
    schema = "id string, affected array<struct<package: struct<ecosystem: string, name: string>, ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>>>"
    a = spark.read.schema(schema).option("multiLine", True).json(path).select("id", F.explode("affected").alias("a")).select("id", "a.package.ecosystem", F.col("a.package.name").alias("package"), F.explode("a.ranges").alias("r"))
    intro = F.filter(F.transform("r.events", lambda e: e["introduced"]), lambda x: x.isNotNull())
    fixed = F.filter(F.transform("r.events", lambda e: e["fixed"]), lambda x: x.isNotNull())
    z = F.arrays_zip(intro.alias("introduced"), fixed.alias("fixed"))
    return a.select("id", "ecosystem", "package", F.explode(z).alias("z")).select("id", "ecosystem", "package", F.col("z.introduced").alias("introduced"), F.col("z.fixed").alias("fixed"))


def version_key(column: str):
    """A version as a comparable struct of major, minor and patch; missing parts are 0."""
    p = lambda i: F.coalesce(F.regexp_extract(column, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("long"), F.lit(0))
    return F.struct(p(1).alias("major"), p(2).alias("minor"), p(3).alias("patch"))


def affected(packages: DataFrame, advs: DataFrame) -> DataFrame:
    """Packages (``ecosystem, package, version``) in an advisory's range: with ``id, introduced, fixed``."""
    j = packages.join(advs, ["ecosystem", "package"])
    return j.where((version_key("version") >= version_key("introduced")) & (F.col("fixed").isNull() | (version_key("version") < version_key("fixed"))))
