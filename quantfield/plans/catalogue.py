"""All queries on fields, each with the SQL that DuckDB answers alike (or none)."""

from __future__ import annotations

from . import blocks, coding, molecules, points, stencils, transforms

QUERIES: dict = {}
ORACLES: dict = {}
for _group in (points, transforms, stencils, molecules, blocks, coding):
    QUERIES |= _group.QUERIES
    ORACLES |= _group.ORACLES
