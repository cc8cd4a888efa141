"""A query for each operator over the driver's tables, and its SQL."""

from __future__ import annotations

from . import queries_tables, queries_text
from .queries_tables import ORACLE_SQL, QUERIES, view_order_summary

__all__ = ["ORACLE_SQL", "QUERIES", "queries_tables", "queries_text", "view_order_summary"]
