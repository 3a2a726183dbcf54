"""All registered queries of the core."""

from __future__ import annotations

from . import aggregates, models, relational, selections, texts  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
