"""Every registered query with its equivalent SQL."""

from __future__ import annotations


def all_queries() -> dict:
    from . import file_queries, load_queries, result_queries

    return {**load_queries.QUERIES, **result_queries.QUERIES, **file_queries.QUERIES}
