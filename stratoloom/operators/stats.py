"""Statistics: summaries, effect sizes, tests and retrieval metrics.

Moments and ranks are aggregated in Spark; what is left (a handful of numbers) is turned into
p-values on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import value_ranks


# ---- distributions (no library for them is at hand) -------------------------
def normal_cdf(x: float) -> float:
    """P(Z <= x) of the standard normal distribution."""
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """The x with P(Z <= x) = p, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def student_cdf(t: float, df: float) -> float:
    """P(T <= t) of Student's distribution."""
    p = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - p if t > 0 else p


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) of the chi-squared distribution, by series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * head
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * head


# ---- summaries and effect sizes ---------------------------------------------
def moments(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group ``n, mean, sd, min, max, median, skewness, kurtosis`` of the non-null values."""
    v = F.col(value).cast("double")
    return df.groupBy(*group).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.when(F.count(v) == 1, 0.0)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis")
    )


def two_arms(df: DataFrame, arm: str, treatment, control, value: str) -> DataFrame:
    """One row with ``n, mean, var, median`` of both arms (suffixes ``_t`` and ``_c``)."""
    cols = []
    for s, a in (("t", treatment), ("c", control)):
        v = F.when(F.col(arm) == F.lit(a), F.col(value).cast("double"))
        cols += [F.count(v).alias(f"n_{s}"), F.avg(v).alias(f"mean_{s}"), F.var_samp(v).alias(f"var_{s}"), F.median(v).alias(f"median_{s}")]
    return df.agg(*cols)


def effect_sizes(arms: DataFrame) -> DataFrame:
    """``cohens_d, hedges_g, rel_change_median`` from :func:`two_arms`.

    d is NaN below two values in an arm and 0 for a pooled deviation of 0; the relative change is null for
    a control median of 0.
    """
    n, m = F.col("n_t"), F.col("n_c")
    pooled = F.sqrt(((n - 1) * F.col("var_t") + (m - 1) * F.col("var_c")) / (n + m - 2))
    d = F.when((n < 2) | (m < 2), F.lit(float("nan"))).when(pooled == 0, 0.0).otherwise((F.col("mean_t") - F.col("mean_c")) / pooled)
    return arms.select(d.alias("cohens_d"), (d * (1 - 3 / (4 * (n + m - 2) - 1))).alias("hedges_g"), F.when(F.col("median_c") != 0, (F.col("median_t") - F.col("median_c")) / F.abs("median_c")).alias("rel_change_median"))


def _arm_counts(df: DataFrame, arm: str, treatment, control, value: str) -> DataFrame:
    both = df.where(F.col(arm).isin(treatment, control) & F.col(value).isNotNull())
    return both.groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.when(F.col(arm) == F.lit(treatment), 1)).alias("t"), F.count(F.when(F.col(arm) == F.lit(control), 1)).alias("c"))


def mann_whitney(df: DataFrame, arm: str, treatment, control, value: str) -> DataFrame:
    """One row ``u, cliffs_delta, rank_biserial, z, n_t, n_c`` (u of the treatment, ties count half).

    The pairs are never formed: with the counts per distinct value, ranked in two levels, the number of
    pairs won is a sum over values.  z has the tie and continuity corrections.
    """
    counts = _arm_counts(df, arm, treatment, control, value)
    # the running count of control values below each distinct value
    spread = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    sums = spread.groupBy("part").agg(F.sum("c").alias("pc"))
    off = sums.select("part", F.coalesce(F.sum("pc").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = spread.withColumn("inner", inner).join(F.broadcast(off), "part")
    s = r.agg(F.sum(F.col("t") * (F.col("off") + F.col("inner") + F.col("c") / 2)).alias("u"), F.sum("t").alias("n_t"), F.sum("c").alias("n_c"), F.sum((F.col("t") + F.col("c")).cast("double") * (F.pow(F.col("t") + F.col("c"), 2) - 1)).alias("ties"))
    n, m = F.col("n_t").cast("double"), F.col("n_c").cast("double")
    total = n + m
    sd = F.sqrt(n * m / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    diff = F.col("u") - n * m / 2
    z = F.when(sd > 0, F.signum(diff) * F.greatest(F.abs(diff) - 0.5, F.lit(0.0)) / sd).otherwise(0.0)
    return s.select("u", (2 * F.col("u") / (n * m) - 1).alias("cliffs_delta"), (2 * F.col("u") / (n * m) - 1).alias("rank_biserial"), z.alias("z"), "n_t", "n_c")


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """One row ``w_plus, w_minus, n, z`` of the signed ranks of non-zero differences (mean ranks for ties)."""
    d = df.where(F.col(difference).isNotNull() & (F.col(difference) != 0)).select(F.abs(F.col(difference).cast("double")).alias("a"), (F.col(difference) > 0).alias("pos"))
    ranks = value_ranks(d, "a").select(F.col("value").alias("a"), (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), F.col("n").alias("ties"))
    per = d.groupBy("a").agg(F.count(F.when(F.col("pos"), 1)).alias("p"), F.count(F.when(~F.col("pos"), 1)).alias("q")).join(ranks, "a")
    s = per.agg(F.sum(F.col("p") * F.col("rank")).alias("w_plus"), F.sum(F.col("q") * F.col("rank")).alias("w_minus"), F.sum(F.col("p") + F.col("q")).alias("n"), F.sum(F.pow("ties", 3) - F.col("ties")).alias("t"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    return s.select("w_plus", "w_minus", "n", F.when(sd > 0, (F.col("w_plus") - n * (n + 1) / 4) / sd).otherwise(0.0).alias("z"))


# ---- tests over a handful of numbers ----------------------------------------
def welch_test(n_t: int, mean_t: float, var_t: float, n_c: int, mean_c: float, var_c: float) -> dict:
    """``t, df, p`` (two-sided) of Welch's test; p is 1 for equal means without variance."""
    a, b = var_t / n_t, var_c / n_c
    if a + b == 0:
        return {"t": 0.0, "df": float(n_t + n_c - 2), "p": 1.0 if mean_t == mean_c else 0.0}
    t = (mean_t - mean_c) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n_t - 1) + b * b / (n_c - 1))
    return {"t": t, "df": df, "p": min(1.0, 2 * (1 - student_cdf(abs(t), df)))}


def equivalence_test(n_t: int, mean_t: float, var_t: float, n_c: int, mean_c: float, var_c: float, margin: float) -> dict:
    """``p`` of two one-sided Welch tests: the greater of the two, for a difference within the margin."""
    a, b = var_t / n_t, var_c / n_c
    se = math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n_t - 1) + b * b / (n_c - 1)) if se else n_t + n_c - 2
    diff = mean_t - mean_c
    if not se:
        return {"p": 0.0 if abs(diff) < margin else 1.0, "df": float(df)}
    return {"p": max(1 - student_cdf((diff + margin) / se, df), student_cdf((diff - margin) / se, df)), "df": df}


def binomial_test(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided exact p: the probability of all outcomes no likelier than this one."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0) + ((n - i) * math.log1p(-p) if n - i else 0) for i in range(n + 1)] if 0 < p < 1 else [0.0 if i == (n if p else 0) else -math.inf for i in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in logs if x <= logs[k] + 1e-7))


def mcnemar_test(b: int, c: int) -> dict:
    """``statistic, p``: exact below 25 discordant pairs, else chi-squared with continuity correction."""
    if b + c < 25:
        return {"statistic": float(min(b, c)), "p": binomial_test(min(b, c), b + c) if b + c else 1.0}
    x = (abs(b - c) - 1) ** 2 / (b + c)
    return {"statistic": x, "p": chi2_sf(x, 1)}


def normality_test(n: int, skew: float, kurt: float) -> dict:
    """D'Agostino-Pearson ``k2, p`` from the sample's skewness and excess kurtosis; needs 20 values."""
    if n < 20:
        return {"k2": math.nan, "p": math.nan}
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    a = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y / a) / math.sqrt(0.5 * math.log(w2))
    e = 3 * (n - 1) / (n + 1)
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / math.sqrt(v)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    m = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    q = (1 - 2 / m) / (1 + x * math.sqrt(2 / (m - 4)))
    z2 = (1 - 2 / (9 * m) - math.copysign(abs(q) ** (1 / 3), q)) / math.sqrt(2 / (9 * m))
    k2 = z1 * z1 + z2 * z2
    return {"k2": k2, "p": math.exp(-k2 / 2)}


def required_per_arm(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Values needed in each arm to see a standardised effect."""
    return math.ceil(2 * ((normal_quantile(1 - alpha / 2) + normal_quantile(power)) / effect) ** 2)


def adjust_pvalues(pvalues: list[float], method: str = "holm") -> list[float]:
    """Adjusted p-values by Bonferroni, Holm or Benjamini-Hochberg, in the order given."""
    p = np.asarray(pvalues, float)
    n, order = len(p), np.argsort(p, kind="stable")
    out = np.empty(n)
    if method == "bonferroni":
        return np.minimum(1, p * n).tolist()
    if method == "holm":
        out[order] = np.minimum(1, np.maximum.accumulate((n - np.arange(n)) * p[order]))
    elif method == "bh":
        out[order] = np.minimum(1, np.minimum.accumulate((n / np.arange(1, n + 1) * p[order])[::-1])[::-1])
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.tolist()


def bootstrap_interval(df: DataFrame, arm: str, treatment, control, value: str, rounds: int = 400, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """One row ``diff, low, high``: the difference of means with a percentile interval.

    A Poisson bootstrap: every row has in each round a weight drawn from Poisson(1) by a hash of the row's
    values and number, so rounds are sums that are combined before the shuffle and nothing is resampled.
    """
    d = df.where(F.col(arm).isin(treatment, control) & F.col(value).isNotNull()).select((F.col(arm) == F.lit(treatment)).alias("t"), F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("i"))
    # thresholds of the cumulative Poisson(1) distribution
    steps, p, c = [], math.exp(-1), 0.0
    for k in range(9):
        c += p
        steps.append(c)
        p /= k + 1
    rows = d.select("t", "v", "i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    u = F.pmod(F.xxhash64("i", "r", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    w = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    b = rows.withColumn("w", w).groupBy("r").agg(*[F.try_divide(F.sum(F.when(F.col("t") == F.lit(x), F.col("v") * F.col("w"))), F.sum(F.when(F.col("t") == F.lit(x), F.col("w")))).alias(n) for x, n in ((True, "a"), (False, "b"))])
    point = d.agg((F.avg(F.when(F.col("t"), F.col("v"))) - F.avg(F.when(~F.col("t"), F.col("v")))).alias("diff"))
    ci = b.agg(F.percentile(F.col("a") - F.col("b"), F.lit(alpha / 2)).alias("low"), F.percentile(F.col("a") - F.col("b"), F.lit(1 - alpha / 2)).alias("high"))
    # both sides are one row
    return point.crossJoin(ci)


# ---- retrieval metrics --------------------------------------------------------
def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query ``ndcg, precision, recall, reciprocal_rank, average_precision`` at ``k``.

    ``ranked`` has ``query, item, rank`` (from 1), ``relevant`` has ``query, item, gain``.  DCG is
    ``sum gain / log2(rank + 1)``, average precision is over all relevant items; queries without relevant
    items are left out, those without results have 0.  Repeats count with the best rank and gain.
    """
    rel = relevant.where("gain > 0").groupBy("query", "item").agg(F.max("gain").alias("gain"))
    top = ranked.groupBy("query", "item").agg(F.min("rank").alias("rank")).where(F.col("rank") <= k)
    hit = top.join(rel, ["query", "item"])
    hit = hit.withColumn("found", F.row_number().over(Window.partitionBy("query").orderBy("rank", "item")))
    got = hit.groupBy("query").agg(
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("found") / F.col("rank")).alias("ap")
    )
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "item"))
    ideal = rel.withColumn("r", order).groupBy("query").agg(F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    z = F.lit(0.0)
    return ideal.join(got, "query", "left").select(
        "query",
        F.coalesce(F.col("dcg") / F.col("idcg"), z).alias("ndcg"),
        F.coalesce(F.col("hits") / F.lit(float(k)), z).alias("precision"),
        F.coalesce(F.col("hits") / F.col("relevant"), z).alias("recall"),
        F.coalesce(1 / F.col("first"), z).alias("reciprocal_rank"),
        F.coalesce(F.col("ap") / F.col("relevant"), z).alias("average_precision"),
    )


def anderson_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, a2, p`` of normality for every group, without gathering a group's values.

    Ranks are prefix sums over range partitions of the different values; groups of fewer than 8
    values or without spread have nulls, null groups and values are left out.
    """
    from ..session import Cuts, map_frames
    from .windows import value_ranks

    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.struct(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).alias("gv"))
    r = Cuts(df.sparkSession, "anderson").cut(value_ranks(d, "gv").select("value.g", "value.v", "n", "before"))
    m = r.groupBy("g").agg(F.sum("n").alias("total"), F.min("before").alias("first"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    m = m.join(r, "g").groupBy("g", "total", "first", "mean").agg(F.sqrt(F.try_divide(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), 2)), F.col("total") - 1)).alias("sd"))
    fit = m.where("total >= 8 and sd > 0")
    z = r.join(fit, "g").select("g", "n", "total", (F.col("before") - F.col("first")).alias("i"), ((F.col("v") - F.col("mean")) / F.col("sd")).alias("z"))

    def terms(batches):
        for b in batches:
            p = np.clip([normal_cdf(x) for x in b["z"]], 1e-300, 1 - 1e-16)
            low, high = b["n"] * (2 * b["i"] + b["n"]), b["n"] * (2 * (b["total"] - b["i"]) - b["n"])
            yield b[["g", "total"]].assign(part=low * np.log(p) + high * np.log1p(-p))

    kind = df.schema[group].dataType.simpleString()
    s = map_frames(z, terms, f"g {kind}, total long, part double").groupBy("g", "total").agg(F.sum("part").alias("s"))
    n = F.col("total")
    s = s.select("g", ((-n - F.col("s") / n) * (1 + 0.75 / n + 2.25 / (n * n))).alias("a"))
    a = F.col("a")
    p = (
        F.when(a >= 0.6, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a))
        .when(a >= 0.34, F.exp(0.9177 - 4.279 * a - 1.38 * a * a))
        .when(a >= 0.2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a))
        .otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
    )
    return m.join(s, "g", "left").select(F.col("g").alias(group), F.col("total").alias("n"), a.alias("a2"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))


# The published constants of the test.
def anderson_darling(counts: list[tuple[float, int]]) -> dict:
    """``a2, p`` of normality from (value, count) pairs in any order (mean and deviation estimated)."""
    pts = sorted(counts)
    n = sum(c for _, c in pts)
    if n < 8:
        return {"a2": math.nan, "p": math.nan}
    mean = sum(v * c for v, c in pts) / n
    sd = math.sqrt(sum(c * (v - mean) ** 2 for v, c in pts) / (n - 1))
    if sd == 0:
        return {"a2": math.nan, "p": math.nan}
    total, i = 0.0, 0
    for v, c in pts:
        p = min(max(normal_cdf((v - mean) / sd), 1e-300), 1 - 1e-16)
        # places i+1 .. i+c count from below for ln F and from above for ln (1 - F)
        low = c * (2 * i + c)
        high = c * (2 * (n - i) - c)
        total += low * math.log(p) + high * math.log1p(-p)
        i += c
    a = (-n - total / n) * (1 + 0.75 / n + 2.25 / n**2)
    if a >= 0.6:
        p = math.exp(1.2937 - 5.709 * a + 0.0186 * a * a)
    elif a >= 0.34:
        p = math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    elif a >= 0.2:
        p = 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    else:
        p = 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)
    return {"a2": a, "p": min(1.0, max(0.0, p))}
