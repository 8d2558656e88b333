"""Registered queries: each operator on the given tables, next to the SQL it must equal."""

from cohortline.queries.registry import REGISTRY, Query
from cohortline.queries import cleaning, clinical, cohorts, files, longitudinal, statistics  # noqa: F401  (fill the registry)

__all__ = ["REGISTRY", "Query"]
