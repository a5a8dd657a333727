"""All queries of the library outside the text operators, by name, with their SQL."""

from __future__ import annotations

from cellweave.queries import analysis, courses, explaining, holding, modelling, more, readers, reading, sources
from cellweave.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "courses", "explaining", "holding", "modelling", "more", "readers", "reading", "sources"]
