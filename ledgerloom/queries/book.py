"""How queries register, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from ledgerloom import catalog


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
        """Registers f(bound, spark) -> DataFrame under a name; sql may use the bound entities named in uses."""

        def put(f: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(catalog.Bound(spark, sf_dir))
            if sql:
                self.sql[name] = catalog.with_entities(sql, uses)
            return f

        return put
