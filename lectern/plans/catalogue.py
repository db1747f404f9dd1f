"""All queries of the question bank with their SQL twins."""

from __future__ import annotations

from lectern.plans import audits, importing, layouts, learning, reading, sequences, streams, texts  # noqa: F401  (they register their queries)
from lectern.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
