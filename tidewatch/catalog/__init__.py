"""Registered queries, each over whole tables, with the SQL that gives the same result."""

from importlib import import_module

from tidewatch.catalog.book import ORACLE, QUERIES

for _module in (
    "signals", "joint", "similarity", "tables", "text", "shaping", "screening", "causality",
    "plans",
):
    import_module(f"tidewatch.catalog.{_module}")

__all__ = ["ORACLE", "QUERIES"]
