"""Registered queries of the panel engine with their SQL."""

from __future__ import annotations

from . import audit_queries, grid_queries, ladder_queries, loader_queries, model_queries, panel_queries, piece_queries, report_queries, stat_queries, window_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "flagship_weekly_risk"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
