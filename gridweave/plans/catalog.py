"""All named queries and the SQL that checks them."""

from __future__ import annotations

from . import feature_queries, io_queries, list_queries, topology_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
