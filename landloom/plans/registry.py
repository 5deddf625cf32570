"""All queries of the land-cover operators, gathered from the catalogue modules."""

from __future__ import annotations

from landloom.plans import local, models, relations, spatial, steps, timeline

QUERIES: dict = {}
SQL: dict = {}
for module in (local, timeline, spatial, relations, models, steps):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
