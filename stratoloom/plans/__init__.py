"""The registered queries of the core and their SQL."""

from __future__ import annotations

from . import code, graphs, hierarchy, history, learning, relational, reports, statistics, streams, text, vectors

_MODULES = (hierarchy, relational, history, vectors, text, graphs, statistics, streams, learning, reports, code)


def core_queries() -> dict:
    """All core queries by name."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def core_sql() -> dict[str, str]:
    """The SQL of the core queries that have one."""
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
