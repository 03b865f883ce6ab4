"""Queries over the driver's tables, one per operator, with their SQL."""

from __future__ import annotations

from quadrille.plans import fmm_queries, list_queries, more_queries, tree_queries, work_queries

PARTS = (tree_queries, list_queries, fmm_queries, work_queries, more_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for part in PARTS for name, text in part.SQL.items()}
