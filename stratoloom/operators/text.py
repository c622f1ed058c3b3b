"""Chunking, search, labelling and scanning of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import map_frames
from .windows import first_per_key


def line_windows(docs: DataFrame, id_col: str, text: str, size: int = 50, overlap: int = 10) -> DataFrame:
    """Windows of ``size`` lines that share ``overlap`` lines: ``id, chunk_index, content, start_line, end_line``.

    Lines count from 1.  The windows stop where the rest is shorter than the overlap.  Null and empty
    texts give no windows; NUL characters are dropped.
    """
    step = max(1, size - overlap)
    lines = F.split(F.translate(F.col(text), "\x00", ""), "\n")
    d = docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).alias("id"), lines.alias("lines"))
    # the last window is the first that reaches the end, or leaves less than the overlap behind it
    n = F.size("lines")
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("k") * step
    part = F.slice("lines", start + 1, size)
    return d.select("id", F.col("k").alias("chunk_index"), F.array_join(part, "\n").alias("content"), (start + 1).alias("start_line"), (start + F.size(part)).alias("end_line"))


def headings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Sections by Markdown headings: ``id, section, level, title, content``; what stands before the first is level 0."""
    marked = F.split(F.regexp_replace(F.col(text), r"(?m)^(?=#{1,6} )", "\u0001"), "\u0001")
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(marked).alias("section", "content")).where(F.trim("content") != "")
    head = F.regexp_extract("content", r"^(#{1,6}) +([^\n]*)", 1)
    return d.select("id", "section", F.length(head).alias("level"), F.trim(F.regexp_extract("content", r"^(#{1,6}) +([^\n]*)", 2)).alias("title"), "content")


def paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Stretches between blank lines: ``id, paragraph, content``."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text), r"\n[ \t]*\n+")).alias("paragraph", "content"))
    return d.withColumn("content", F.trim("content")).where(F.length("content") > 0)


def front_matter(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, fields, body``: the key-value head between two lines of dashes as a map, and the rest."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+[ \t]*:"))
    # of a key that comes twice the first counts
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([A-Za-z0-9_-]+)[ \t]*:", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    firsts = F.filter(entries, lambda x, i: F.array_position(F.transform(entries, lambda y: y["k"]), x["k"]) == i + 1)
    body = F.regexp_replace(text, r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", "")
    return docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.map_from_entries(firsts).alias("fields"), body.alias("body"))


def term_frequencies(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """``id, term, tf`` from an array of words per row."""
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def identifier_terms(df: DataFrame, keep: list, text: str, least: int = 3, most: int = 50) -> DataFrame:
    """The ``keep`` columns with ``word``, a row for each word of the text's identifiers.

    What :func:`functions.text.identifier_words` gives, but filtered after the words are rows, where the
    conditions are compiled.
    """
    split = F.regexp_replace(F.col(text), r"([a-z0-9])([A-Z])", "$1 $2")
    rows = df.select(*keep, F.explode(F.regexp_extract_all(F.lower(split), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    n = F.length("word")
    return rows.where((n >= least) & (n <= most) & ~F.col("word").isin(*sorted(T.STOP_WORDS)) & ~F.col("word").rlike(r"^\d+$"))


def all_terms_search(tf: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Documents with every term, by ``sum(1 + ln tf)``: ``id, score``; ties go to the smaller id."""
    wanted = sorted({t.lower() for t in terms} - T.STOP_WORDS)
    hits = tf.where(F.col("term").isin(wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(1 + F.log("tf")).alias("score"))
    return hits.where(F.col("n") == len(wanted)).select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def bm25(tf: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best ``k`` documents for any of the terms by BM25: ``id, score``."""
    wanted = sorted({t.lower() for t in terms})
    lengths = tf.groupBy("id").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    hits = tf.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # the statistics are one row, the terms those of the query
    h = hits.join(F.broadcast(df), "term").join(lengths, "id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return h.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def grep_first(chunks: DataFrame, file_col: str, order: str, text: str, pattern: str) -> DataFrame:
    """The first chunk of each file that the pattern matches."""
    return first_per_key(chunks.where(F.col(text).rlike(pattern)), [file_col], [F.col(order)])


def class_tf_idf(words: DataFrame, top: int, df_cap_share: float = 0.4) -> DataFrame:
    """Labels of classes: ``class, word, score, rank`` from ``class, word, weight``.

    ``tf = weight / total weight of the class``, ``idf = ln(1 + mean class weight / df)`` with df the number
    of classes that have the word; words in more than ``ceil(0.4 k)`` of ``k >= 5`` classes label none.
    """
    w = words.groupBy("class", "word").agg(F.sum("weight").alias("w"))
    totals = w.groupBy("class").agg(F.sum("w").alias("total"))
    mean = totals.agg(F.avg("total").alias("mean"), F.count(F.lit(1)).alias("k"))
    df = w.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # one row
    s = w.join(totals, "class").join(df, "word").crossJoin(F.broadcast(mean))
    s = s.where((F.col("k") < 5) | (F.col("df") <= F.ceil(df_cap_share * F.col("k"))))
    s = s.withColumn("score", F.col("w") / F.greatest("total", F.lit(1)) * F.log(1 + F.col("mean") / F.col("df")))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "word"))
    return s.withColumn("rank", rank).where(F.col("rank") <= top).select("class", "word", "score", "rank")


def entropy(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """Per group ``kinds, entropy`` (nats) and ``normalised`` by ln of the number of kinds (0 below two)."""
    total = counts.groupBy(*group).agg(F.sum(n).alias("_t"))
    p = counts.join(total, group).where(F.col(n) > 0).withColumn("_p", F.col(n) / F.col("_t"))
    out = p.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds"), (-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"))
    return out.withColumn("normalised", F.when(F.col("kinds") >= 2, F.col("entropy") / F.log("kinds")).otherwise(F.lit(0.0)))


def js_divergence(a: DataFrame, b: DataFrame, kind: str, n: str) -> DataFrame:
    """Jensen-Shannon divergence in bits of two tables of counts: one row ``jsd``, 1 if one has no mass."""
    pa = a.groupBy(kind).agg(F.sum(n).alias("na"))
    pb = b.groupBy(kind).agg(F.sum(n).alias("nb"))
    j = pa.join(pb, kind, "full").select(F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    t = j.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    # one row
    p = j.crossJoin(F.broadcast(t)).select("ta", "tb", (F.col("na") / F.nullif("ta", F.lit(0))).alias("p"), (F.col("nb") / F.nullif("tb", F.lit(0))).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = 0.5 * F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / F.col("m"))).otherwise(0.0) + 0.5 * F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / F.col("m"))).otherwise(0.0)
    return p.agg(F.when((F.first("ta") > 0) & (F.first("tb") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(part)))).otherwise(F.lit(1.0)).alias("jsd"))


def closest_words(df: DataFrame, word: str, query: str, most: int, k: int) -> DataFrame:
    """The ``k`` different words within an edit distance: ``word, distance`` (insert, delete, replace)."""
    d = df.select(F.col(word).alias("word")).distinct().withColumn("distance", F.levenshtein("word", F.lit(query), most))
    return d.where("distance >= 0").orderBy("distance", "word").limit(k)


def closest_words_transposed(df: DataFrame, word: str, query: str, most: int, k: int) -> DataFrame:
    """As :func:`closest_words`, a swap of two neighbours counting as one step."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(distance=[T.damerau(w, query, most) for w in b["word"]])

    near = df.select(F.col(word).alias("word")).distinct().where(F.abs(F.length("word") - len(query)) <= most)
    return map_frames(near, look, "word string, distance int").where("distance >= 0").orderBy("distance", "word").limit(k)


def find_markers(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Comment markers: ``id, marker, note`` for every occurrence."""
    pattern = r"\b(?:" + "|".join(T.MARKERS) + r")\b:?[^\n]*"
    d = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("hit"))
    return d.select("id", F.regexp_extract("hit", r"^([A-Z]+)", 1).alias("marker"), F.trim(F.regexp_replace("hit", r"^[A-Z]+:?", "")).alias("note"))


def find_secrets(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Secrets: ``id, kind, hits``, by known beginnings, and quoted strings of 24 and more characters as candidates."""
    out = None
    for kind, pattern in {**T.SECRET_PATTERNS, "quoted_candidate": T.QUOTED_CANDIDATE}.items():
        n = F.size(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
        part = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.lit(kind).alias("kind"), n.alias("hits")).where("hits > 0")
        out = part if out is None else out.unionByName(part)
    return out


# How the languages write imports.
IMPORT_PATTERNS = {
    "python": r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+))",
    "javascript": r"(?:import|export)[^'\"\n;]*from[ \t]*['\"]([^'\"]+)['\"]|(?:require|import)\([ \t]*['\"]([^'\"]+)['\"]",
    "rust": r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)",
    "go": r"(?m)^(?:import)?[ \t]*(?:[\w.]+[ \t]+)?\"([\w./-]+)\"[ \t]*$",
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)",
}


def extract_imports(files: DataFrame, id_col: str, lang: str, text: str) -> DataFrame:
    """``id, target`` for every import in files of the known languages; repeats count once."""
    out = None
    for name, pattern in IMPORT_PATTERNS.items():
        groups = 2 if name in ("python", "javascript") else 1
        f = files.where((F.lower(lang) == name) & F.col(text).isNotNull())
        for g in range(1, groups + 1):
            part = f.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g))).alias("target")).where("target <> ''")
            out = part if out is None else out.unionByName(part)
    return out.distinct()
