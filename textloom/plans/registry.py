"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from textloom.plans import more, relational, series, text  # noqa: F401
from textloom.plans._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
