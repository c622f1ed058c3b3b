"""User-defined tables of JSON rows: declared columns, defaults, validation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("text", "integer", "number", "boolean", "timestamp", "json")
MOST_ROW_BYTES = 256 * 1024
_IDENTIFIER = re.compile(r"^[a-z][a-z0-9_]{0,62}$")


@dataclass(frozen=True)
class ColumnSpec:
    """A declared column: one of :data:`TYPES`, perhaps required, perhaps with a default in JSON."""

    name: str
    type: str
    required: bool = False
    default: str | None = None

    def __post_init__(self):
        if not _IDENTIFIER.match(self.name):
            raise ValueError(f"bad column name {self.name!r}")
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type!r}")


def _raw(name: str):
    return F.col("_v").getItem(name)


def _fits(c: ColumnSpec):
    """Whether the JSON value of a column is of its type (null fits everything but a required column)."""
    s = F.trim(_raw(c.name))
    is_text = s.startswith('"')
    num = s.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    ok = {
        "text": is_text,
        "integer": num & (s.try_cast("double") == F.floor(s.try_cast("double"))),
        "number": num & s.try_cast("double").isNotNull(),
        "boolean": s.isin("true", "false"),
        "timestamp": F.when(is_text, F.try_to_timestamp(inner).isNotNull()).otherwise(num),
        "json": F.lit(True),
    }[c.type]
    return F.coalesce(ok, F.lit(False))


def validate(rows: DataFrame, column: str, specs: list[ColumnSpec], reject_unknown: bool = False) -> DataFrame:
    """The rows with ``data`` (defaults filled in) and ``errors``, all that is wrong with a row.

    A row must be a JSON object of at most 256 KiB.  Absent columns take their default, then required
    ones must be there and not null, and every value must be of its type; undeclared fields pass unless
    they are rejected.  A null row is no object.
    """
    parsed = F.from_json(column, "map<string,string>", {"allowUnquotedControlChars": "true"})
    raw = F.when(F.get_json_object(column, "$").startswith("{"), parsed)
    r = rows.withColumn("_m", raw)
    kinds = F.map_from_arrays(F.array(*[F.lit(k.name) for k in specs]), F.array(*[F.to_json(F.try_variant_get(F.try_parse_json(column), f"$.{k.name}", "variant")) for k in specs])) if specs else F.create_map()
    r = r.withColumn("_v", kinds)
    errors = [F.when(F.col("_m").isNull(), F.lit("not an object")), F.when(F.octet_length(column) > MOST_ROW_BYTES, F.lit("row too large"))]
    filled = F.col("_m")
    for c in specs:
        absent = ~F.coalesce(F.array_contains(F.json_object_keys(column), c.name), F.lit(False))
        value = _raw(c.name)
        null = value.isNull() | (value == "null")
        if c.required and c.default is None:
            errors.append(F.when(F.col("_m").isNotNull() & null, F.lit(f"{c.name}: required")))
        errors.append(F.when(F.col("_m").isNotNull() & ~null & ~_fits(c), F.lit(f"{c.name}: not {c.type}")))
        if c.default is not None:
            filled = F.when(absent, F.map_concat(filled, F.create_map(F.lit(c.name), F.lit(c.default.strip('"'))))).otherwise(filled)
    if reject_unknown:
        known = F.array(*[F.lit(c.name) for c in specs])
        extra = F.array_except(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), known)
        errors.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ", "))))
    return r.withColumn("data", filled).withColumn("errors", F.filter(F.array(*errors), lambda x: x.isNotNull())).drop("_m", "_v")


def merge_objects(left, right):
    """Shallow merge of two JSON objects given as maps; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)


def drop_key(m, key: str):
    """A map without a key."""
    return F.map_filter(m, lambda k, v: k != key)
