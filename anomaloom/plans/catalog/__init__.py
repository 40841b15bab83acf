"""Queries over the given tables, one per operator, with SQL twins where SQL can say it."""

from anomaloom.plans.catalog import (  # noqa: F401
    flow_queries,
    incident_queries,
    log_queries,
    metric_queries,
    model_queries,
    source_queries,
)
from anomaloom.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
