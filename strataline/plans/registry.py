"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}
_ONCE: set[str] = set()


def cte(name: str, sql: str, once: bool = False) -> None:
    """Name a derived relation so that check SQL can refer to it; ``once`` has it worked out a single time."""
    _CTES[name] = sql
    if once:
        _ONCE.add(name)


def _needed(sql: str, found: list[str]) -> list[str]:
    for name, body in _CTES.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def expand(sql: str) -> str:
    """Put the derived relations a statement mentions in front of it."""
    body = sql.strip()
    names = _needed(body, [])
    parts = [f"{n} AS {'MATERIALIZED ' * (n in _ONCE)}(\n{_CTES[n]}\n)" for n in names]
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if head:
        own = body[head.end():]
        rec = "RECURSIVE " if head.group(1) else ""
        return f"WITH {rec}" + ",\n".join(parts + [own]) if parts else body
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t`` gives access to the source tables."""

    def wrap(fn):
        def run(spark, sf_dir):
            from .relations import Tables

            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
