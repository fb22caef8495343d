"""All queries of the library by name, and their SQL for DuckDB."""

from __future__ import annotations

from cueline.plans import caption_queries, clip_queries, lifecycle_queries, maintenance_queries, quality_queries, report_queries, search_queries, service_queries, text_queries  # noqa: F401
from cueline.plans.base import ORACLES, QUERIES

FLAGSHIP = "quality_gate"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
