"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import case_queries, other_queries, score_queries, signal_queries

QUERIES = score_queries.QUERIES | case_queries.QUERIES | signal_queries.QUERIES | other_queries.QUERIES
ORACLES = score_queries.ORACLES | case_queries.ORACLES | signal_queries.ORACLES | other_queries.ORACLES
