"""Registered queries of the library proper, and their SQL."""

from __future__ import annotations

from ampflow.plans import q_clean, q_evaluate, q_features, q_ingest, q_models, q_segment

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (q_clean, q_segment, q_features, q_ingest, q_evaluate, q_models):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES

entry = q_segment.entry
