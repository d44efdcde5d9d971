"""Registration of a query family: DataFrame function plus oracle SQL."""

from __future__ import annotations


class Family:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return add
