"""The registered queries and their SQL."""

from __future__ import annotations

from panelforge.plans import detail_queries, evaluation_queries, feature_queries, history_queries, lifecycle_queries, matrix_queries, model_queries, panel_queries, raw_queries, reading_queries, source_queries, stream_queries, tape_queries, text_queries

_PARTS = [feature_queries, panel_queries, text_queries, history_queries, stream_queries, source_queries, tape_queries, raw_queries, matrix_queries, model_queries, lifecycle_queries, evaluation_queries, detail_queries, reading_queries]
QUERIES: dict = {}
SQL: dict = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL


def flagship(spark, sf_dir):
    """Daily top and bottom decile spread of 20-session momentum."""
    return QUERIES["b1_daily_baskets"](spark, sf_dir)
