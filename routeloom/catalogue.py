"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations


def _registered():
    # each module registers its queries as it is imported
    from routeloom.plans import address_queries, job_queries, map_queries, queries, sheet_queries  # noqa: F401
    from routeloom.plans import registry

    return registry


def queries() -> dict:
    return dict(_registered().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_registered().ORACLES)
