"""All queries and their SQL by key."""

from __future__ import annotations

from wattline.plans import corpus_facts, decisions, desk, discovery, registry_queries, sourcing, trust  # noqa: F401
from wattline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
