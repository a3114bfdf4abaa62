"""All registered queries of the library's operators."""

from __future__ import annotations

from loomery.plans import relational_queries, sampling_queries, scalar_queries, sequence_queries, shard_queries, vector_queries  # noqa: F401
from loomery.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
