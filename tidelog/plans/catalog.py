"""All registered queries."""

from __future__ import annotations

from tidelog.plans import (  # noqa: F401  (importing a module registers its queries)
    chunk_queries,
    cleaning_queries,
    files_queries,
    merge_queries,
    stats_queries,
    stream_queries,
)
from tidelog.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
