"""Every operator applied to the given tables.

The tables stand in for business data of the same shape: orders for scanned
documents, line items for pages and lines, customers and suppliers for the
records documents refer to, events for runs, calls and feedback.
"""

from papertally.catalog import (  # noqa: F401
    documents,
    matching,
    pages,
    permissions,
    quality,
    reports,
    review,
    texts,
)
from papertally.catalog.registry import ORACLE, QUERIES, TABLES, Tables

__all__ = ["ORACLE", "QUERIES", "TABLES", "Tables"]
