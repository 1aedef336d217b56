"""The registered queries: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries with their oracles under unique names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query registered twice: {name}")
        self.queries[name] = query
        if oracle is not None:
            self.oracles[name] = oracle


def full_catalog() -> Catalog:
    from veilspan.plans import (audits, detection, entities, flows, live, redaction, restoration,
                                routes, sources, upkeep)
    catalog = Catalog()
    for group in (sources, detection, entities, redaction, restoration, routes, audits, live, flows, upkeep):
        group.register(catalog)
    return catalog
