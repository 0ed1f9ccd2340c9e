"""Whole workflows, and the registered queries with their SQL."""

from importlib import import_module

#: Modules that register queries.
MODULES = ["text_queries", "retrieval_queries", "table_queries", "chunk_queries", "layout_queries", "answer_queries", "workflow_queries", "ingest_queries"]


def load_queries():
    """(queries, SQL) by name."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    catalog = import_module(f"{__name__}.catalog")
    return catalog.QUERIES, catalog.ORACLES
