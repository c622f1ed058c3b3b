"""Text queries over documents, files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import text as X
from ..operators.joins import rank_fusion
from ..sources.tables import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents", *(cols or ("doc_id", "text")))


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_TF = f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) "


@query("SELECT file_id, min(chunk_index) AS chunk_index FROM file_chunks WHERE regexp_matches(content, '(?i)return\\s+err') GROUP BY file_id")
def grep_first_match(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "file_chunks", "file_id", "chunk_index", "content")
    return X.grep_first(c, "file_id", "chunk_index", "content", r"(?i)return\s+err").select("file_id", "chunk_index")


@query(_TF + "SELECT doc_id AS id, term, tf FROM tf WHERE tf >= 5")
def token_tf(spark: SparkSession, d: str) -> DataFrame:
    return X.term_frequencies(_docs(spark, d), "doc_id", T.tokens("text")).where("tf >= 5")


@query(_TF + "SELECT doc_id AS id, round(sum(1 + ln(tf)), 6) AS score FROM tf WHERE term IN ('chunks', 'index') GROUP BY 1 HAVING count(*) = 2 ORDER BY sum(1 + ln(tf)) DESC, id LIMIT 50")
def fts_and_rank(spark: SparkSession, d: str) -> DataFrame:
    tf = X.term_frequencies(_docs(spark, d), "doc_id", T.tokens("text"))
    return X.all_terms_search(tf, ["chunks", "the", "index"], 50).withColumn("score", F.round("score", 6))


_BM = """, l AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l), h AS (SELECT * FROM tf WHERE term IN ('topic', 'queue')), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
 b AS (SELECT doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM h JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1) """


@query(_TF + _BM + "SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    tf = X.term_frequencies(_docs(spark, d), "doc_id", T.tokens("text"))
    return X.bm25(tf, ["topic", "queue"], 20).withColumn("score", F.round("score", 6))


@query(
    _TF
    + """, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY sum(1 + ln(tf)) DESC, doc_id) AS rank FROM tf WHERE term IN ('chunks') GROUP BY doc_id ORDER BY rank LIMIT 40),
 b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 40) SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b ON a.id = b.id"""
)
def rrf_search(spark: SparkSession, d: str) -> DataFrame:
    tf = X.term_frequencies(_docs(spark, d), "doc_id", T.tokens("text"))
    # legs are ranked after their limit
    a = X.all_terms_search(tf, ["chunks"], 40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rank")
    b = _docs(spark, d, "doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(40)
    b = b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))).select(F.col("doc_id").alias("id"), "rank")
    return rank_fusion([(a, 0.5), (b, 0.5)]).select("id", F.round("score", 9).alias("score"))


_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS)) + ")"
_CHUNK_WORDS = rf"""WITH c AS (SELECT chunk_id, max(content) AS content FROM file_chunks WHERE content IS NOT NULL GROUP BY 1), a AS (SELECT DISTINCT chunk_id, topic_id, membership_score AS m FROM assignments),
 w0 AS (SELECT chunk_id, unnest(regexp_extract_all(lower(regexp_replace(content, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+')) AS word FROM c),
 w AS (SELECT * FROM w0 WHERE length(word) BETWEEN 3 AND 50 AND NOT regexp_full_match(word, '\d+') AND word NOT IN {_STOP}),
 t AS (SELECT a.topic_id AS class, w.word, sum(a.m) AS w FROM w JOIN a USING (chunk_id) GROUP BY 1, 2), n AS (SELECT class, sum(w) AS total FROM t GROUP BY 1), k AS (SELECT avg(total) AS mean, count(*) AS k FROM n), f AS (SELECT word, count(*) AS df FROM t GROUP BY 1),
 s AS (SELECT t.class, t.word, t.w / greatest(total, 1) * ln(1 + mean / df) AS score FROM t JOIN n USING (class) JOIN f USING (word) CROSS JOIN k WHERE k < 5 OR df <= ceil(0.4 * k)) """


@query(_CHUNK_WORDS + "SELECT class, word, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(score, 10) DESC, word) <= 5")
def ctf_idf(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "file_chunks", "chunk_id", "content").where("content is not null").groupBy("chunk_id").agg(F.max("content").alias("content"))
    w = X.identifier_terms(c, ["chunk_id"], "content").groupBy("chunk_id", "word").agg(F.count(F.lit(1)).alias("n"))
    a = table(spark, d, "assignments", "chunk_id", "topic_id", "membership_score").distinct()
    words = w.join(a, "chunk_id").select(F.col("topic_id").alias("class"), "word", (F.col("membership_score") * F.col("n")).alias("weight"))
    return X.class_tf_idf(words, 5).select("class", "word", F.round("score", 6).alias("score"))


@query(_TF + ", p AS (SELECT doc_id, tf / sum(tf) OVER (PARTITION BY doc_id) AS p FROM tf) SELECT doc_id AS id, count(*) AS kinds, round(-sum(p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) >= 2 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS normalised FROM p GROUP BY 1")
def entropy_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = X.entropy(X.term_frequencies(_docs(spark, d), "doc_id", T.tokens("text")), ["id"], "tf")
    return e.select("id", "kinds", F.round("entropy", 6).alias("entropy"), F.round("normalised", 6).alias("normalised"))


@query(
    f"""WITH t AS (SELECT lang, unnest({_TOK}) AS w FROM documents WHERE lang IN ('en', 'de')), c AS (SELECT w, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'de') AS b FROM t GROUP BY 1),
 p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c) SELECT round(sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS jsd FROM p"""
)
def jsd_lang(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d, "lang", "text").where("lang in ('en', 'de')").select("lang", F.explode(T.tokens("text")).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    return X.js_divergence(t.where("lang = 'en'"), t.where("lang = 'de'"), "w", "n").withColumn("jsd", F.round("jsd", 6))


@query(f"WITH t AS (SELECT DISTINCT unnest({_TOK}) AS word FROM documents) SELECT word, CAST(levenshtein(word, 'topic') AS INTEGER) AS distance FROM t WHERE levenshtein(word, 'topic') <= 3 ORDER BY 2, 1 LIMIT 40")
def levenshtein_topk(spark: SparkSession, d: str) -> DataFrame:
    return X.closest_words(_docs(spark, d).select(F.explode(T.tokens("text")).alias("w")), "w", "topic", 3, 40)


@query(f"WITH t AS (SELECT DISTINCT unnest({_TOK}) AS word FROM documents) SELECT word, CAST(damerau_levenshtein(word, 'topic') AS INTEGER) AS distance FROM t WHERE damerau_levenshtein(word, 'topic') <= 3 ORDER BY 2, 1 LIMIT 40")
def damerau_topk(spark: SparkSession, d: str) -> DataFrame:
    return X.closest_words_transposed(_docs(spark, d).select(F.explode(T.tokens("text")).alias("w")), "w", "topic", 3, 40)


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, list_distinct(list_transform(range(1, length('  ' || lower(p_name) || ' ') - 1), lambda i: substring('  ' || lower(p_name) || ' ', i, 3))) AS g FROM n),
 q AS (SELECT list_distinct(list_transform(range(1, length('  part 100 ') - 1), lambda i: substring('  part 100 ', i, 3))) AS q) SELECT p_name, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS similarity FROM g CROSS JOIN q"""
)
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part", "p_name").distinct().withColumn("q", F.lit("part 100"))
    n = n.select("p_name", T.trigrams("p_name").alias("g"), T.trigrams("q").alias("qg"))
    return n.select("p_name", F.round(T.set_similarity("g", "qg"), 6).alias("similarity"))


_MARK = r"\b(?:" + "|".join(T.MARKERS) + r")\b:?[^\n]*"


@query(f"WITH h AS (SELECT file_id AS id, unnest(regexp_extract_all(content, '{_MARK}')) AS hit FROM indexed_files) SELECT id, regexp_extract(hit, '^([A-Z]+)', 1) AS marker, trim(regexp_replace(hit, '^[A-Z]+:?', '')) AS note FROM h")
def marker_scan(spark: SparkSession, d: str) -> DataFrame:
    return X.find_markers(table(spark, d, "indexed_files", "file_id", "content"), "file_id", "content")


_SECRETS = {**T.SECRET_PATTERNS, "quoted_candidate": T.QUOTED_CANDIDATE}


@query(" UNION ALL ".join("SELECT file_id AS id, '" + k + "' AS kind, len(regexp_extract_all(content, '" + p.replace("'", "''") + "')) AS hits FROM indexed_files WHERE len(regexp_extract_all(content, '" + p.replace("'", "''") + "')) > 0" for k, p in _SECRETS.items()))
def secret_regex(spark: SparkSession, d: str) -> DataFrame:
    return X.find_secrets(table(spark, d, "indexed_files", "file_id", "content"), "file_id", "content")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g')) AS plain FROM documents WHERE NOT regexp_matches(text, '<!--|<(script|style)|&(nbsp|lt|gt|quot|#39|amp);')""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).where(~F.col("text").rlike("<!--|<(script|style)|&(nbsp|lt|gt|quot|#39|amp);")).select("doc_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    return t.select("doc_id", T.strip_html("html").alias("plain"))


@query()
def html_strip_all(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`html_strip`, for all documents, those with comments, scripts, styles and entities too."""
    return _docs(spark, d).select("doc_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html")).select("doc_id", T.strip_html("html").alias("plain"))


_FILES = "WITH f AS (SELECT file_id AS id, replace(max_by(content, indexed_at), chr(0), '') AS content FROM indexed_files GROUP BY 1), l AS (SELECT id, string_split(content, chr(10)) AS lines FROM f WHERE length(content) > 0) "


def _current(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "language", "content"), "file_id", "indexed_at")


@query(
    _FILES
    + """, k AS (SELECT id, lines, unnest(range(0, CAST(greatest(1, ceil((len(lines) - 10) / 40.0)) AS BIGINT))) AS k FROM l) SELECT id, CAST(k AS INTEGER) AS chunk_index, CAST(k * 40 + 1 AS INTEGER) AS start_line, CAST(least(k * 40 + 50, len(lines)) AS INTEGER) AS end_line,
 md5(array_to_string(lines[k * 40 + 1:k * 40 + 50], chr(10))) AS digest FROM k"""
)
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.line_windows(_current(spark, d), "file_id", "content").select("id", "chunk_index", "start_line", "end_line", F.md5("content").alias("digest"))


@query(_FILES + ", k AS (SELECT id, lines, unnest(range(0, CAST(greatest(1, ceil((len(lines) - 25) / 75.0)) AS BIGINT))) AS k FROM l) SELECT id, count(*) AS windows, CAST(max(least(k * 75 + 100, len(lines))) AS INTEGER) AS last_line FROM k GROUP BY 1")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return X.line_windows(_current(spark, d), "file_id", "content", 100, 25).groupBy("id").agg(F.count(F.lit(1)).alias("windows"), F.max("end_line").alias("last_line"))


@query("WITH f AS (SELECT file_id AS id, max_by(content, indexed_at) AS content FROM indexed_files WHERE lower(language) = 'markdown' GROUP BY 1), h AS (SELECT id, unnest(regexp_extract_all(content, '(?m)^(#{1,6}) +([^\\n]*)', 0)) AS h FROM f) SELECT id, CAST(length(regexp_extract(h, '^(#+)', 1)) AS INTEGER) AS level, trim(replace(regexp_extract(h, '^#+ +(.*)', 1), chr(13), '')) AS title FROM h")
def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    f = latest(table(spark, d, "indexed_files", "file_id", "indexed_at", "language", "content").where("lower(language) = 'markdown'"), "file_id", "indexed_at")
    return X.headings(f, "file_id", "content").where("level > 0").select("id", "level", F.regexp_replace("title", "\r", "").alias("title"))


@query()
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return X.extract_imports(_current(spark, d), "file_id", "language", "content")


@query(r"WITH t AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t WHERE len(w) >= 2) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 20")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select(T.tokens("text").alias("w"))
    return w.select(F.explode(T.ngrams("w", 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
