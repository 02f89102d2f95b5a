"""Every registered query with the SQL it must agree with."""

from __future__ import annotations

from . import corpus_queries, document_queries, graph_queries, text_queries, tree_queries  # noqa: F401  (they fill the register)
from .base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
