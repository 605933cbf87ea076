"""Queries of this subpackage by name, and their SQL for the check where SQL can express them."""

from __future__ import annotations

from lodestrand.llm import clusters, mixing, neighbours, spans, splitting, tokenizing, topn

QUERIES = {
    "p1_found": neighbours.p1_found,
    "p1_neighbours": neighbours.p1_neighbours,
    "p2_found": clusters.p2_found,
    "p2_clusters": clusters.p2_clusters,
    "p3_found": splitting.p3_found,
    "p3_balanced": splitting.p3_balanced,
    "p4_found": topn.p4_found,
    "p6_ids": tokenizing.p6_ids,
    "p7_mixture": mixing.p7_mixture,
    "p7_shares": mixing.p7_shares,
    "p8_found": spans.p8_found,
    "p8_shared": spans.p8_shared,
}

ORACLES = {
    "p1_found": neighbours.P1_SQL,
    "p2_found": clusters.P2_SQL,
    "p3_found": splitting.P3_SQL,
    "p3_balanced": splitting.P3_BALANCED_SQL,
    "p4_found": topn.P4_SQL,
    "p8_found": spans.P8_SQL,
    "p8_shared": spans.P8_SHARED_SQL,
}
