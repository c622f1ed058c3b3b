"""Change-history analytics: co-change, churn, ownership, change points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def co_change(changes: DataFrame, commit: str, item: str, most_items: int = 50, least_jaccard: float = 0.0, least_joint: int = 1) -> DataFrame:
    """Pairs of items that change together: ``item_a, item_b, joint, n_a, n_b, jaccard`` (a < b).

    Commits that touch more than ``most_items`` different items say little and are left out (that is
    the measure, not a cap on the work); the counts of the single items are over the same commits.
    Repeated rows count once, null commits and items not at all.
    """
    c = changes.where(F.col(commit).isNotNull() & F.col(item).isNotNull()).select(F.col(commit).alias("c"), F.col(item).alias("i")).distinct()
    small = c.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_items).select("c")
    c = c.join(small, "c")
    each = c.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    pairs = c.select("c", F.col("i").alias("item_a")).join(c.select("c", F.col("i").alias("item_b")), "c").where("item_a < item_b")
    joint = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= least_joint)
    out = joint.join(each.select(F.col("i").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(each.select(F.col("i").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    return out.withColumn("jaccard", F.col("joint") / (F.col("n_a") + F.col("n_b") - F.col("joint"))).where(F.col("jaccard") >= least_jaccard).select("item_a", "item_b", "joint", "n_a", "n_b", "jaccard")


def with_mutual_information(pairs: DataFrame, commits: int) -> DataFrame:
    """Adds ``mi``: the mutual information in bits of two items' presence over ``commits`` commits."""
    n = float(commits)
    j, a, b = F.col("joint"), F.col("n_a"), F.col("n_b")

    def term(cell, x, y):
        p = cell / n
        return F.when(cell > 0, p * F.log2(p / ((x / n) * (y / n)))).otherwise(F.lit(0.0))

    return pairs.withColumn("mi", term(j, a, b) + term(a - j, a, n - b) + term(b - j, n - a, b) + term(n - a - b + j, n - a, n - b))


def churn(changes: DataFrame, item: str, commit: str, author: str, at: str, message: str, now) -> DataFrame:
    """Per item its commits, authors, fix share, last change and commits per month since then (at least one month of 30 days)."""
    fix = F.col(message).rlike("(?i)(fix|bug|patch|hotfix|resolve|closes?|fixes)")
    out = changes.groupBy(item).agg(
        F.countDistinct(commit).alias("commits"), F.countDistinct(author).alias("authors"), F.countDistinct(F.when(fix, F.col(commit))).alias("fixes"), F.max(at).alias("last_change")
    )
    months = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_change").cast("timestamp"))) / (86400.0 * 30)
    return out.withColumn("churn_rate", F.col("commits") / F.greatest(months, F.lit(1.0))).withColumn("fix_ratio", F.col("fixes") / F.col("commits"))


def concentration(shares: DataFrame, group: str, amount: str) -> DataFrame:
    """Per group ``n, hhi, gini`` of the amounts of its members.

    HHI is the sum of squared shares, Gini ``sum((2i - n - 1) x_i) / (n sum x)`` over ascending x; both
    are null where the amounts sum to 0.  Gini's ranks come from one window per group.
    """
    w = Window.partitionBy(group).orderBy(amount)
    r = shares.where(F.col(amount).isNotNull()).withColumn("_i", F.row_number().over(w))
    agg = r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("s"), F.sum(F.col(amount) * F.col(amount)).alias("s2"), F.sum(F.col("_i") * F.col(amount)).alias("si"))
    return agg.select(
        group,
        "n",
        F.when(F.col("s") != 0, F.col("s2") / (F.col("s") * F.col("s"))).alias("hhi"),
        F.when(F.col("s") != 0, (2 * F.col("si") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).alias("gini"),
    )


def bus_factor(shares: DataFrame, item: str, owner: str, amount: str, coverage: float) -> DataFrame:
    """How many owners, largest first, hold ``coverage`` of an item: ``item, bus_factor, owners, top_share``."""
    w = Window.partitionBy(item).orderBy(F.desc(amount), owner)
    run = F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(amount).over(Window.partitionBy(item))
    r = shares.withColumns({"_run": run, "_total": total})
    return r.groupBy(item).agg(
        (F.count(F.when(F.col("_run") < coverage * F.col("_total") - 1e-9, 1)) + 1).alias("bus_factor"), F.count(F.lit(1)).alias("owners"), (F.max(amount) / F.first("_total")).alias("top_share")
    )


def growth_buckets(rows: DataFrame, at: str, unit: str, group: list[str], amount: str | None = None) -> DataFrame:
    """Rows (or the sum of an amount) per group and week, month or quarter: ``bucket, added``."""
    value = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return rows.where(F.col(at).isNotNull()).groupBy(*group, F.date_trunc(unit, F.col(at)).alias("bucket")).agg(value.alias("added"))


def cusum_change_points(series: DataFrame, key: str, at: str, value: str, least_points: int = 4, drift: float = 0.5, threshold: float = 4.0) -> DataFrame:
    """Upward change points of each key's series: ``key, change_at, peak, mean, sigma``.

    ``S = max(0, S + x - mean - drift * sigma)`` with sigma the population deviation, at least 0.5; a
    key is reported if the greatest S passes ``threshold * sigma`` by more than rounding (a relative
    1e-9, so that a tie is none), at the first place of that S.
    Series with fewer than ``least_points`` points are left out, and so are null times and values.
    The sum is folded over a sorted array inside the JVM; a key's series is one row.
    """
    s = series.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("x")))).alias("pts"), F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(0.5)).alias("sigma"), F.count(F.lit(1)).alias("n")
    )
    s = s.where(F.col("n") >= least_points)
    fold = F.expr(
        f"aggregate(pts, named_struct('s', 0D, 'peak', -1D, 'at', cast(null as {dict(series.dtypes)[at]})), "
        f"(acc, p) -> named_struct('s', greatest(0D, acc.s + p.x - mean - {drift} * sigma), "
        f"'peak', greatest(acc.peak, greatest(0D, acc.s + p.x - mean - {drift} * sigma)), "
        f"'at', if(greatest(0D, acc.s + p.x - mean - {drift} * sigma) > acc.peak, p.t, acc.at)))"
    )
    return s.withColumn("f", fold).where(F.col("f.peak") > threshold * F.col("sigma") * (1 + 1e-9)).select(key, F.col("f.at").alias("change_at"), F.col("f.peak").alias("peak"), "mean", "sigma")


def linear_trend(series: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept per group; null for fewer than two points or equal x."""
    return series.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.max_by(y, x).alias("latest"))


def weeks_to(threshold: float, latest, slope_per_day):
    """Weeks until a trend reaches the threshold; null if it is flat or leads away."""
    w = (F.lit(threshold) - latest) / slope_per_day / 7
    return F.when((slope_per_day != 0) & (w > 0), w)
