"""Registry of the core queries and of their DuckDB statements."""

from __future__ import annotations

from . import insight, matching, quality, workflow

QUERIES: dict = {**matching.QUERIES, **quality.QUERIES, **insight.QUERIES, **workflow.QUERIES}
ORACLES: dict = {**matching.ORACLES, **quality.ORACLES, **insight.ORACLES, **workflow.ORACLES}
