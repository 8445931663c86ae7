"""Registered queries over the standard tables, with equivalent SQL."""

from __future__ import annotations

from docquarry.plans import documents, lookup, tables
from docquarry.plans.registry import ORACLE_SQL, QUERIES

flagship = lookup.search_bm25

__all__ = ["ORACLE_SQL", "QUERIES", "documents", "flagship", "lookup", "tables"]
