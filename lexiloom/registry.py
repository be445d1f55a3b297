"""Collects the registered queries and their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("operators.dedup", "operators.blocks", "operators.gates", "operators.sensitive", "operators.chunks", "operators.batching", "operators.retrieval", "operators.evaluation", "operators.usage", "operators.changes", "sources.urls", "sources.linkgraph", "sources.markup", "sources.delimited", "streaming.events", "streaming.leases", "streaming.buckets", "sources.pagestore")

QUERIES: dict = {}
ORACLES: dict = {}


def collect(package: str, modules: tuple[str, ...], queries: dict, oracles: dict) -> None:
    """Adds each module's ``QUERIES`` (name to (callable, SQL or None)) to the two mappings."""
    for module in modules:
        for name, (run, sql) in importlib.import_module(f"{package}.{module}").QUERIES.items():
            if name in queries:
                raise ValueError(f"query {name} is registered twice")
            queries[name] = run
            if sql:
                oracles[name] = sql


collect("lexiloom", MODULES, QUERIES, ORACLES)
