"""All queries of the volumetric operators and their oracle SQL."""

from __future__ import annotations

from lattiq.plans import build_queries, field_queries, io_queries, more_queries, scene_queries, track_queries, volume_queries  # noqa: F401
from lattiq.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
