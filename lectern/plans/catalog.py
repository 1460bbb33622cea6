"""All registered queries of the knowledge-base operators, with their SQL oracles."""

from __future__ import annotations

from lectern.plans import builds, documents, fetching, registry, reports, retrieval, store


def queries() -> dict:
    return {**documents.QUERIES, **retrieval.QUERIES, **registry.QUERIES, **reports.QUERIES, **store.QUERIES, **builds.QUERIES, **fetching.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**documents.SQL, **retrieval.SQL, **registry.SQL, **reports.SQL, **store.SQL, **builds.SQL, **fetching.SQL}
