"""Queries of the core by name, each a function of session and data directory, and their SQL for the check."""

from __future__ import annotations

from lodestrand.operators import shredding
from lodestrand.plans import operator_queries, release_queries, similarity_queries

FLAGSHIP = "sim_topk"

QUERIES = {
    **similarity_queries.QUERIES,
    **release_queries.QUERIES,
    **operator_queries.QUERIES,
    **shredding.QUERIES,
}

ORACLES: dict[str, str] = {**similarity_queries.ORACLES, **release_queries.ORACLES, **operator_queries.ORACLES, **shredding.ORACLES}
