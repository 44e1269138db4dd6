"""All registered queries of the engine, gathered from its modules."""

from __future__ import annotations

from . import registry
from .functions import text_queries
from .operators import assemble_queries, dedup_queries, extract_queries, gate_queries, generate_queries, packing_queries, retrieval_queries, scoring_queries, split_queries
from .plans import predicate_queries
from .plans.predicate_queries import flagship
from .sources import source_queries
from .streaming import event_queries

MODULES = [predicate_queries, text_queries, extract_queries, packing_queries, retrieval_queries, dedup_queries, scoring_queries, gate_queries, split_queries, generate_queries, assemble_queries, source_queries, event_queries]

__all__ = ["MODULES", "flagship", "queries", "oracle_sql"]


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
