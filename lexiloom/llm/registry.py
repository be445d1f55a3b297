"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from lexiloom.registry import collect

MODULES = ("hosts", "chat", "digest", "simhash", "substring", "decontaminate", "quality", "pii", "bpe", "pages", "vector_codes", "manifest", "language")

QUERIES: dict = {}
ORACLES: dict = {}

collect("lexiloom.llm", MODULES, QUERIES, ORACLES)

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
