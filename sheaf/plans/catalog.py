"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    """Queries by name, with SQL where SQL can express them."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def put(f):
            n = name or f.__name__
            self.queries[n] = f
            if sql is not None:
                self.sql[n] = sql
            return f

        return put
