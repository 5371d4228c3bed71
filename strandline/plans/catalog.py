"""All queries of the panel engine."""

from __future__ import annotations

from . import feature_queries, panel_queries

QUERIES = feature_queries.QUERIES | panel_queries.QUERIES
ORACLES = feature_queries.ORACLES | panel_queries.ORACLES


def flagship(spark, sf_dir):
    """Bars to features to ranks by date: one shuffle by entity, one by date."""
    return QUERIES["cs_rank"](spark, sf_dir)
