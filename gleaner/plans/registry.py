"""All queries of the library outside ``llm``, with their SQL twins."""

from __future__ import annotations

from . import fanout, pages, records, stores, streams  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
