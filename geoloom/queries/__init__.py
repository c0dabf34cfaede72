"""The registered queries over rasters, features and catalogs, each with its SQL."""

from __future__ import annotations

from ..registry import ORACLE_SQL, QUERIES
from . import catalog_queries, grid_queries, kernel_queries, mosaic_queries, pixel_queries, plan_queries, source_queries, stat_queries, vector_queries  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
