"""Row filters over typed columns and JSON documents.

A filter is a list of ``(column, op, value)`` joined by AND or OR, without nesting.  Columns are
given as a :class:`Fields`, which says how a field is read: a plain column or a key of a JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "ne", "gt", "lt", "gte", "lte", "contains", "exists")
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class Fields:
    """Where the fields of a filter come from: columns of their own, or keys of a JSON text column."""

    def __init__(self, json_column: str | None = None, types: dict[str, str] | None = None):
        self.json_column, self.types = json_column, types or {}

    def _path(self, name: str) -> str:
        return "$." + name if _NAME.match(name) else "$['" + name.replace("'", "\\'") + "']"

    def text(self, name: str) -> Column:
        """The field as text; null if it is absent or null."""
        if self.json_column is None:
            return F.col(f"`{name}`").cast("string")
        return F.get_json_object(self.json_column, self._path(name))

    def typed(self, name: str, value=None) -> Column:
        """The field for ordered comparison: by its declared type, else numeric if the value is a number."""
        if self.json_column is None:
            return F.col(f"`{name}`")
        kind = self.types.get(name)
        if kind in ("integer", "number") or kind is None and isinstance(value, (int, float)) and not isinstance(value, bool):
            return self.text(name).try_cast("double")
        if kind == "timestamp":
            return F.try_to_timestamp(self.text(name))
        return self.text(name)

    def present(self, name: str) -> Column:
        """Whether the key is there; a null value counts as there, a null document as empty."""
        if self.json_column is None:
            return F.col(f"`{name}`").isNotNull()
        return F.coalesce(F.array_contains(F.json_object_keys(self.json_column), name), F.lit(False))


def _raw(fields: Fields, name: str, op: str, value=None) -> Column:
    """The predicate as the scan can take it: null where the field is absent (which a filter drops)."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}; one of {', '.join(OPS)}")
    if op == "exists":
        return fields.present(name)
    if op in ("eq", "ne"):
        if value is None:
            same = fields.text(name).isNull() & (fields.present(name) if fields.json_column else F.lit(True))
            return same if op == "eq" else ~same
        if isinstance(value, bool):
            left, right = (fields.text(name), "true" if value else "false") if fields.json_column else (fields.typed(name), value)
        elif isinstance(value, (int, float)):
            left, right = (fields.text(name).try_cast("double") if fields.json_column else fields.typed(name)), value
        elif isinstance(value, (list, dict)):
            left, right = fields.text(name), json.dumps(value, separators=(",", ":"))
        else:
            left, right = (fields.text(name) if fields.json_column else fields.typed(name)), value
        return left == F.lit(right) if op == "eq" else left.isNull() | (left != F.lit(right))
    if op == "contains":
        return F.contains(F.lower(fields.text(name)), F.lower(F.lit(str(value))))
    left = fields.typed(name, value)
    right = F.to_timestamp(F.lit(value)) if fields.types.get(name) == "timestamp" and isinstance(value, str) else F.lit(value)
    return {"gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[op]


def predicate(fields: Fields, name: str, op: str, value=None) -> Column:
    """One predicate, never null.

    ``eq`` is false and ``ne`` true where the field is absent or null; ordered comparisons and
    ``contains`` (a literal substring, whatever the case) are false there, and where the field
    cannot be read as the type they compare by.  A number equals its text with any zero fraction.
    """
    return F.coalesce(_raw(fields, name, op, value), F.lit(False))


def combine(fields: Fields, conditions: Iterable[tuple], any_of: bool = False) -> Column:
    """All (or any) of the conditions, for a filter; no condition at all holds for every row.

    Means what :func:`predicate` does, but is null instead of false where a field is absent, so that
    comparisons of plain columns reach the scan.
    """
    out = None
    for c in conditions:
        p = _raw(fields, *c)
        out = p if out is None else (out | p if any_of else out & p)
    return F.lit(True) if out is None else out


def optional(column: str, value) -> Column:
    """``column = value``, or no condition if the value is None (decided when the plan is built)."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def glob_to_regex(pattern: str) -> str:
    """A regular expression for a glob of ``*`` and ``?``; everything else is literal."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob_match(column: str, pattern: str) -> Column:
    """Whether the whole text fits the glob; false for null."""
    return F.coalesce(F.col(column).rlike("(?s)" + glob_to_regex(pattern)), F.lit(False))


def word_boundaries(pattern: str) -> str:
    """The pattern with the GNU word boundaries turned into the ones Java knows."""
    return pattern.replace(r"\<", r"\b(?=\w)").replace(r"\>", r"\b(?<=\w)")


def valid_at(at, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether an interval, closed at its start and open at its end (null: without end), holds a moment."""
    at = F.lit(at) if not isinstance(at, Column) else at
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))
