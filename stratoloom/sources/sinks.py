"""Writing: appends, upserts, replacing by partition, reports."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import few_or_raise

FORMATS = ("markdown", "org", "latex", "html", "text", "json", "csv")
#: A report is for reading; tables beyond this are written with ``df.write`` instead.
MOST_REPORT_ROWS = 10_000


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep=None) -> DataFrame:
    """Old rows with the new ones put in their place by key.

    Of several new rows with one key the greatest (of all columns) counts; with ``keep`` (a column
    name) the row with the greatest value of it survives, old or new.
    """
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(old.columns).withColumn("_new", F.lit(1)))
    order = F.struct(*([F.col(keep)] if keep else []), F.col("_new"), *[F.col(c) for c in rest])
    best = both.groupBy(*key).agg(F.max(order).alias("_b")) if not keep else both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*[F.col(c) if c in key else F.col(f"_b.{c}").alias(c) for c in old.columns])


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write the rows in place of those of the same partitions; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def ontology_facts(edges: DataFrame, predicate: str = "is_a") -> DataFrame:
    """Lines of Prolog facts from ``src, dst``: one text column ``value``."""
    atom = lambda c: F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return edges.where("src is not null and dst is not null").select(F.concat(F.lit(f"{predicate}("), atom("src"), F.lit(", "), atom("dst"), F.lit(").")).alias("value"))


def render(df: DataFrame, fmt: str, title: str = "") -> str:
    """A small table as text in one of :data:`FORMATS`; numbers without a fraction show none."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    cols = df.columns
    rows = [[_show(r[c]) for c in cols] for r in few_or_raise(df, MOST_REPORT_ROWS, "report")]
    if fmt == "json":
        return json.dumps([dict(zip(cols, r)) for r in rows], ensure_ascii=False, indent=2)
    if fmt == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(cols)
        w.writerows(rows)
        return out.getvalue()
    if fmt == "html":
        cell = lambda tag, xs: "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs)
        body = "".join(f"<tr>{cell('td', r)}</tr>" for r in rows)
        return (f"<h1>{html.escape(title)}</h1>" if title else "") + f"<table><tr>{cell('th', cols)}</tr>{body}</table>"
    if fmt == "latex":
        esc = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
        lines = [" & ".join(map(esc, r)) + r" \\" for r in [cols, *rows]]
        return "\\begin{tabular}{" + "l" * len(cols) + "}\n" + "\n".join([lines[0], "\\hline", *lines[1:]]) + "\n\\end{tabular}"
    width = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(cols)]
    pad = lambda r: [x.ljust(width[i]) for i, x in enumerate(r)]
    if fmt == "text":
        return "\n".join(([title, ""] if title else []) + ["  ".join(pad(r)).rstrip() for r in [cols, *rows]])
    mark, join = ("|", "-|-") if fmt == "markdown" else ("|", "-+-")
    rule = "|-" + join.join("-" * w for w in width) + "-|"
    head = [f"# {title}" if fmt == "markdown" else f"* {title}", ""] if title else []
    line = lambda r: f"{mark} " + " | ".join(x.replace("|", "\\|") for x in pad(r)) + f" {mark}"
    return "\n".join([*head, line(cols), rule, *map(line, rows)])


def _show(v) -> str:
    if v is None:
        return ""
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return str(v)


def ontology_edn(edges: DataFrame, predicate: str = "is-a") -> DataFrame:
    """Lines of EDN vectors from ``src, dst``: one text column ``value``."""
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.where("src is not null and dst is not null").select(F.concat(F.lit(f"[:{predicate} "), text("src"), F.lit(" "), text("dst"), F.lit("]")).alias("value"))
