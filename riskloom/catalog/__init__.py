"""Registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from . import clean_queries, feature_queries, model_queries, report_queries, score_queries

ALL = {
    **report_queries.QUERIES,
    **clean_queries.QUERIES,
    **feature_queries.QUERIES,
    **model_queries.QUERIES,
    **score_queries.QUERIES,
}
