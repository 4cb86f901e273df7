"""Registry of contract queries and their SQL counterparts."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    """Register a named SQL view for oracles; ``deps`` come before it."""
    VIEWS[name] = (deps, sql)


def _expand(name: str, seen: list[str]) -> None:
    if name in seen:
        return
    for dep in VIEWS[name][0]:
        _expand(dep, seen)
    seen.append(name)


def _counts_as_bigint(sql: str) -> str:
    """count_if is HUGEINT in DuckDB; wrap each call in a cast."""
    out, at = [], 0
    for m in re.finditer(r"count_if\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(f"{sql[at:m.start()]}cast({sql[m.start():end]} AS BIGINT)")
        at = end
    return "".join(out) + sql[at:]


def compose(sql: str) -> str:
    """Prefix ``sql`` with the views it names, transitively."""
    sql = _counts_as_bigint(sql)
    order: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            _expand(name, order)
    if not order:
        return sql
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn
    return wrap
