"""All queries of the library by name, and the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("detections", "tracks", "joins", "statistics", "survey", "helpers", "streams")


def query(sql: str | None = None) -> Callable:
    """Registers a callable(spark, sf_dir) under its name, with the DuckDB SQL that says the same if there is one."""

    def put(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tidewake.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
