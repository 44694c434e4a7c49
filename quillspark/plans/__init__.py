"""Query registry: what the engine offers as named queries, each with its SQL where SQL can express it."""

from __future__ import annotations


def all_queries() -> dict:
    from . import io_queries, keyword_queries, misc_queries, temporal_queries, text_queries  # noqa: F401
    from .registry import QUERIES

    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    all_queries()
    from .registry import SQL

    return dict(SQL)
