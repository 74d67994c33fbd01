"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import queries_model, queries_plans, queries_series, queries_sources, queries_space, queries_tables

_MODULES = (queries_tables, queries_series, queries_space, queries_plans, queries_sources, queries_model)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
