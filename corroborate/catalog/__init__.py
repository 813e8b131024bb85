"""Registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "ingest_queries", "event_queries", "ops_queries", "stream_queries")


def load():
    """All registered queries by name."""
    from corroborate.catalog.registry import QUERIES

    for module in MODULES:
        import_module(f"corroborate.catalog.{module}")
    return QUERIES
