"""All core queries and their SQL, gathered for ``__spark_entry__.py``."""

from __future__ import annotations

from paperloom.plans import corpus_queries, evaluation_queries, flat, retrieval_queries, text_queries

_PARTS = [flat, text_queries, retrieval_queries, evaluation_queries, corpus_queries]


def queries() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB statement."""
    return {k: v for p in _PARTS for k, v in p.ORACLES.items()}
