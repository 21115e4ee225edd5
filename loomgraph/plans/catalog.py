"""Named queries over the derived graph and tables, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from loomgraph.plans import extract_queries, graph_queries, rule_queries, table_queries  # noqa: F401  they register their queries
from loomgraph.plans.registry import Query, query


def queries() -> dict[str, Query]:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
