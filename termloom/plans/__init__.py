"""Registered queries of the engine's operators and their SQL."""

from __future__ import annotations

from . import activity_queries, deck_queries, document_queries, glossary_queries, harvest_queries, language_queries, memory_queries, more_queries, offline_queries, pairing_queries, sop_queries, style_queries, text_queries, version_queries

_MODULES = (text_queries, language_queries, glossary_queries, memory_queries, activity_queries, document_queries, more_queries, sop_queries, style_queries, offline_queries, deck_queries, pairing_queries, harvest_queries, version_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark, sf_dir):
    """The reuse audit: per language units, reused units and distinct keys."""
    return QUERIES["slice_reuse_audit"](spark, sf_dir)
