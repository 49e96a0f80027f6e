"""The registered queries, each with the SQL that DuckDB runs on the same tables."""

from . import base, catalog, chunks, citations, evidence, federation, retrieval, texts, traces  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
