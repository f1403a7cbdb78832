"""Named queries and their SQL."""

from __future__ import annotations

from . import books, chunks, documents, indexes, pages, search, stores, tables, vectors
from .catalog import QUERIES, SQL

__all__ = ["all_queries", "all_sql", "books", "chunks", "documents", "indexes", "pages", "search", "stores", "tables", "vectors"]


def all_queries() -> dict:
    return QUERIES


def all_sql() -> dict[str, str]:
    return SQL
