"""All registered queries of the library and their SQL."""

from __future__ import annotations

from relevanta.plans import aggregate_queries, file_queries, grid_queries, ranking_queries, summary_queries

FLAGSHIP = "ndcg_at_k"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (ranking_queries, aggregate_queries, summary_queries, grid_queries, file_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
