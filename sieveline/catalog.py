"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from .plans import array_queries, call_queries, evidence_queries, image_queries, metric_queries, result_queries, text_queries

MODULES = (metric_queries, text_queries, array_queries, image_queries, result_queries, evidence_queries, call_queries)
FLAGSHIP = "ag01_confusion_metrics"


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
