"""Queries of the llm operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from . import audit_queries, document_queries

QUERIES = audit_queries.QUERIES | document_queries.QUERIES
SQL = audit_queries.SQL | document_queries.SQL
