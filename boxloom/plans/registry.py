"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Collects the queries of a module; ``@registry(sql)`` registers a function under its name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return keep
