"""A book of queries: each with its plan and, where SQL can say it, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add
