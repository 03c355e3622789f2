"""Registered queries over the given tables."""

from cliplab.plans import (  # noqa: F401
    evaluation,
    manifests,
    parsing,
    quality_queries,
    significance_queries,
    splitting,
    streams,
    tabular,
)
from cliplab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
