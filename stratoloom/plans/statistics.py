"""Statistical queries: error and click events as two arms, search hits as rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.acceptance import evaluate
from ..session import few_or_raise
from ..sources.tables import table

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


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "user_id", "value")


_ARMS = """WITH t AS (SELECT value AS v FROM events WHERE event_type = 'error'), c AS (SELECT value AS v FROM events WHERE event_type = 'click'),
 a AS (SELECT (SELECT count(v) FROM t) AS n_t, (SELECT avg(v) FROM t) AS mean_t, (SELECT var_samp(v) FROM t) AS var_t, (SELECT median(v) FROM t) AS median_t,
 (SELECT count(v) FROM c) AS n_c, (SELECT avg(v) FROM c) AS mean_c, (SELECT var_samp(v) FROM c) AS var_c, (SELECT median(v) FROM c) AS median_c) """


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return S.two_arms(_events(spark, d), "event_type", "error", "click", "value")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM events GROUP BY 1")
def welford_moments(spark: SparkSession, d: str) -> DataFrame:
    m = S.moments(_events(spark, d), ["event_type"], "value")
    return m.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "min", "max", F.round("median", 6).alias("median"))


_D = "(mean_t - mean_c) / sqrt(((n_t - 1) * var_t + (n_c - 1) * var_c) / (n_t + n_c - 2))"


@query(_ARMS + f"SELECT round({_D}, 8) AS cohens_d FROM a")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return S.effect_sizes(_arms(spark, d)).select(F.round("cohens_d", 8).alias("cohens_d"))


@query(_ARMS + f"SELECT round({_D} * (1 - 3 / (4.0 * (n_t + n_c - 2) - 1)), 8) AS hedges_g FROM a")
def hedges_g(spark: SparkSession, d: str) -> DataFrame:
    return S.effect_sizes(_arms(spark, d)).select(F.round("hedges_g", 8).alias("hedges_g"))


@query(_ARMS + "SELECT round((median_t - median_c) / abs(median_c), 8) AS rel_change_median FROM a")
def rel_change_median(spark: SparkSession, d: str) -> DataFrame:
    return S.effect_sizes(_arms(spark, d)).select(F.round("rel_change_median", 8).alias("rel_change_median"))


@query(_ARMS + "SELECT round(avg(sign(t.v - c.v)), 9) AS cliffs_delta FROM t CROSS JOIN c")
def cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    return S.mann_whitney(_events(spark, d), "event_type", "error", "click", "value").select(F.round("cliffs_delta", 9).alias("cliffs_delta"))


@query(_ARMS + "SELECT sum(CASE WHEN t.v > c.v THEN 1.0 WHEN t.v = c.v THEN 0.5 ELSE 0 END)::DOUBLE AS u, (SELECT count(*) FROM t) AS n_t, (SELECT count(*) FROM c) AS n_c FROM t CROSS JOIN c")
def mwu_u(spark: SparkSession, d: str) -> DataFrame:
    return S.mann_whitney(_events(spark, d), "event_type", "error", "click", "value").select("u", "n_t", "n_c")


@query(
    """WITH d AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'error') - avg(value) FILTER (WHERE event_type = 'click') AS x FROM events GROUP BY 1), z AS (SELECT round(x, 9) AS x FROM d WHERE x IS NOT NULL AND round(x, 9) <> 0),
 r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS r FROM z) SELECT coalesce(sum(r) FILTER (WHERE x > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE x < 0), 0)::DOUBLE AS w_minus, count(*) AS n FROM r"""
)
def wilcoxon_w(spark: SparkSession, d: str) -> DataFrame:
    per = _events(spark, d).groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") == "error", F.col("value"))) - F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 9).alias("x"))
    return S.wilcoxon(per, "x").select("w_plus", "w_minus", "n")


@query(_ARMS + "SELECT round((mean_t - mean_c) / sqrt(var_t / n_t + var_c / n_c), 8) AS t, round(power(var_t / n_t + var_c / n_c, 2) / (power(var_t / n_t, 2) / (n_t - 1) + power(var_c / n_c, 2) / (n_c - 1)), 5) AS df FROM a")
def welch_t_stat(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("var_t") / F.col("n_t"), F.col("var_c") / F.col("n_c")
    df = F.pow(a + b, 2) / (a * a / (F.col("n_t") - 1) + b * b / (F.col("n_c") - 1))
    return _arms(spark, d).select(F.round((F.col("mean_t") - F.col("mean_c")) / F.sqrt(a + b), 8).alias("t"), F.round(df, 5).alias("df"))


@query()
def welch_p(spark: SparkSession, d: str) -> DataFrame:
    r = _arms(spark, d).first()
    w = S.welch_test(r.n_t, r.mean_t, r.var_t, r.n_c, r.mean_c, r.var_c)
    return spark.createDataFrame([(w["t"], w["df"], w["p"])], "t double, df double, p double")


@query()
def tost(spark: SparkSession, d: str) -> DataFrame:
    r = _arms(spark, d).first()
    w = S.equivalence_test(r.n_t, r.mean_t, r.var_t, r.n_c, r.mean_c, r.var_c, 1.0)
    return spark.createDataFrame([(w["p"], w["df"])], "p double, df double")


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return S.bootstrap_interval(_events(spark, d), "event_type", "error", "click", "value")


@query()
def p_adjust_holm_bh(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of event types tested, with adjusted p-values (as many rows as there are pairs of types)."""
    m = sorted(few_or_raise(S.moments(_events(spark, d), ["event_type"], "value"), 2000, "event types"), key=lambda r: r.event_type)
    pairs = [(a.event_type, b.event_type, S.welch_test(a.n, a["mean"], a.sd**2, b.n, b["mean"], b.sd**2)["p"]) for i, a in enumerate(m) for b in m[i + 1 :]]
    holm, bh = (S.adjust_pvalues([p for *_, p in pairs], x) for x in ("holm", "bh"))
    return spark.createDataFrame([(a, b, p, h, q) for (a, b, p), h, q in zip(pairs, holm, bh)], "a string, b string, p double, holm double, bh double")


@query()
def normality(spark: SparkSession, d: str) -> DataFrame:
    m = few_or_raise(S.moments(_events(spark, d), ["event_type"], "value"), 100_000, "event types")
    return spark.createDataFrame([(r.event_type, *S.normality_test(r.n, r.skewness, r.kurtosis).values()) for r in m], "event_type string, k2 double, p double")


@query()
def normality_anderson(spark: SparkSession, d: str) -> DataFrame:
    """Anderson-Darling per event type."""
    return S.anderson_by_group(_events(spark, d), "event_type", "value")


@query()
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """A tree of criteria over the two arms."""
    tree = {"kind": "any", "of": [{"kind": "significant", "direction": "greater"}, {"kind": "all", "of": [{"kind": "equivalent", "margin": 5.0}, {"kind": "threshold", "most": 1000.0}]}]}
    r = evaluate(tree, _arms(spark, d).first().asDict())
    return spark.createDataFrame([(r["accepted"], str(r["detail"]))], "accepted boolean, detail string")


@query("SELECT count(*) FILTER (WHERE e AND NOT c) AS b, count(*) FILTER (WHERE c AND NOT e) AS c FROM (SELECT user_id, bool_or(event_type = 'error') AS e, bool_or(event_type = 'click' AND value > 60) AS c FROM events GROUP BY 1)")
def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    u = _events(spark, d).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("e"), F.bool_or((F.col("event_type") == "click") & (F.col("value") > 60)).alias("k"))
    return u.agg(F.count(F.when(F.col("e") & ~F.col("k"), 1)).alias("b"), F.count(F.when(F.col("k") & ~F.col("e"), 1)).alias("c"))


_RANK = """WITH r AS (SELECT query_id AS query, chunk_id AS item, min(hit_rank) AS rank FROM search_results WHERE chunk_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT query_id AS query, chunk_id AS item, max(score) AS gain FROM search_results WHERE chunk_id IS NOT NULL AND score > 0.5 GROUP BY 1, 2),
 t AS (SELECT * FROM r WHERE rank <= 10), h AS (SELECT t.query, t.rank, g.gain, row_number() OVER (PARTITION BY t.query ORDER BY rank, t.item) AS found FROM t JOIN g USING (query, item)),
 i AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY gain DESC, item) AS r, gain FROM g), d AS (SELECT query, sum(gain / log2(r + 1)) FILTER (WHERE r <= 10) AS idcg, count(*) AS n FROM i GROUP BY 1),
 s AS (SELECT query, sum(gain / log2(rank + 1)) AS dcg, count(*) AS hits, min(rank) AS first, sum(found / rank) AS ap FROM h GROUP BY 1) """


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_results", "query_id", "chunk_id", "hit_rank", "score").where("chunk_id is not null")
    ranked = s.select(F.col("query_id").alias("query"), F.col("chunk_id").alias("item"), F.col("hit_rank").alias("rank"))
    rel = s.where("score > 0.5").select(F.col("query_id").alias("query"), F.col("chunk_id").alias("item"), F.col("score").alias("gain"))
    return S.retrieval_metrics(ranked, rel, 10)


@query(_RANK + "SELECT query, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM d LEFT JOIN s USING (query)")
def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query", F.round("ndcg", 6).alias("ndcg"))


@query(_RANK + "SELECT round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM d LEFT JOIN s USING (query)")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


@query(_RANK + "SELECT round(avg(coalesce(ap / n, 0)), 6) AS map FROM d LEFT JOIN s USING (query)")
def mean_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(F.round(F.avg("average_precision"), 6).alias("map"))


@query(_RANK + "SELECT query, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(hits / 10.0, 0), 6) AS precision FROM d LEFT JOIN s USING (query)")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("WITH p AS (SELECT event_type, epoch(ts) / 86400 AS x, value AS y, ts, event_id FROM events) SELECT event_type, count(*) AS n, round(regr_slope(y, x), 6) AS slope FROM p GROUP BY 1")
def ols_slope_eta(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.history import linear_trend

    e = table(spark, d, "events", "event_type", "ts", "value").withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6)
    return linear_trend(e, ["event_type"], "x", "value").select("event_type", "n", F.round("slope", 6).alias("slope"))
