"""All queries of the library."""

from __future__ import annotations

from strandmill.plans import extras, geometry, integrity, quantization, relations, statistics
from strandmill.plans.quantization import flagship
from strandmill.plans.registry import ORACLE, QUERIES

QUERIES = {**QUERIES, **integrity.QUERIES}
ORACLE = {**ORACLE, **integrity.ORACLE}

__all__ = ["ORACLE", "QUERIES", "extras", "flagship", "geometry", "integrity", "quantization", "relations", "statistics"]
