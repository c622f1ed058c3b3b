"""The group-by engine and rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Fields

FUNCS = ("count", "count_distinct", "sum", "avg", "stddev", "median", "min", "max")
NUMERIC = ("sum", "avg", "stddev", "median")


@dataclass(frozen=True)
class Metric:
    """One aggregate: a function, the field it is taken over (None: rows) and its output name."""

    func: str
    field: str | None = None
    name: str | None = None

    @property
    def alias(self) -> str:
        return self.name or (self.func if self.field is None else f"{self.func}_{self.field}")


def number(fields: Fields, name: str) -> Column:
    """The field as a finite number, else null; numeric texts count, booleans do not."""
    text = fields.text(name)
    x = F.when(~F.lower(text).isin("true", "false"), text.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def aggregate(df: DataFrame, groups: list[str], metrics: list[Metric], fields: Fields | None = None) -> DataFrame:
    """Aggregates per group, over all rows.

    Functions: count (rows, or non-null values of a field), count_distinct, sum, avg, stddev (of the
    sample; 0 for one value), median (interpolated), min, max (numeric where the declared type is,
    else by text).  Numeric functions leave out what is no finite number and report how many
    non-null values that were as ``n_ignored_<field>``.  A null or absent group key is a group of its
    own; without groups there is exactly one row, also for an empty table.  A numeric function over a
    field declared as text, boolean or json raises before anything runs.
    """
    fields = fields or Fields()
    cols: list[Column] = []
    ignored: dict[str, Column] = {}
    for m in metrics:
        if m.func not in FUNCS:
            raise ValueError(f"unknown function {m.func!r}")
        if m.func == "count" and m.field is None:
            cols.append(F.count(F.lit(1)).alias(m.alias))
            continue
        if m.field is None:
            raise ValueError(f"{m.func} needs a field")
        kind = fields.types.get(m.field)
        if m.func in NUMERIC:
            if kind in ("text", "boolean", "json"):
                raise ValueError(f"{m.func} over {m.field}, which is {kind}")
            x = number(fields, m.field)
            ignored[m.field] = F.count(F.when(fields.text(m.field).isNotNull() & x.isNull(), 1)).alias(f"n_ignored_{m.field}")
            cols.append(
                {
                    "sum": F.sum(x),
                    "avg": F.avg(x),
                    "stddev": F.coalesce(F.stddev_samp(x), F.when(F.count(x) == 1, F.lit(0.0))),
                    "median": F.median(x),
                }[m.func].alias(m.alias)
            )
        elif m.func == "count":
            cols.append(F.count(fields.text(m.field)).alias(m.alias))
        elif m.func == "count_distinct":
            cols.append(F.countDistinct(fields.text(m.field)).alias(m.alias))
        else:
            pick = F.min if m.func == "min" else F.max
            if kind in ("integer", "number"):
                cols.append(pick(number(fields, m.field)).alias(m.alias))
            elif kind == "timestamp":
                # by the instant, but in the spelling that was given
                by = F.min_by if m.func == "min" else F.max_by
                cols.append(by(fields.text(m.field), F.try_to_timestamp(fields.text(m.field))).alias(m.alias))
            elif fields.json_column is None:
                cols.append(pick(F.col(f"`{m.field}`")).alias(m.alias))
            else:
                cols.append(pick(fields.text(m.field)).alias(m.alias))
    keys = [(fields.text(g) if fields.json_column else F.col(f"`{g}`")).alias(g) for g in groups]
    return df.groupBy(*keys).agg(*cols, *ignored.values())


def rollup_means(df: DataFrame, levels: list[str], metrics: list[str]) -> DataFrame:
    """Unweighted means of the children on every level, from the finest to the whole.

    ``levels`` are columns from the coarsest to the finest.  A level's mean is that of the means of
    the level below (not of all rows, which ``rollup`` would give).  Returns ``level, key, n_children``
    and the metrics; the whole is level ``all`` with a null key.  Null metrics do not count.
    """
    out, current = None, df
    for i in range(len(levels) - 1, -2, -1):
        keys = levels[: i + 1]
        current = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_children"), *[F.avg(m).alias(m) for m in metrics])
        label = levels[i] if i >= 0 else "all"
        key = F.col(levels[i]).cast("string") if i >= 0 else F.lit(None).cast("string")
        part = current.select(F.lit(label).alias("level"), key.alias("key"), "n_children", *metrics)
        out = part if out is None else out.unionByName(part)
    return out


def weighted_completion(df: DataFrame, groups: list[str], weight: str, progress: str) -> DataFrame:
    """Sum of weight times progress over sum of weight per group; null where the weights sum to 0."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    total = F.sum(w)
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("items"), F.when(total != 0, F.sum(w * F.coalesce(F.col(progress), F.lit(0.0))) / total).alias("completion"))
