"""Registered queries with their check SQL."""

from postlab.plans import (  # noqa: F401  (importing registers)
    evaluation_queries, feature_queries, lexicon_queries, model_queries, table_queries,
    text_queries)
from postlab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
