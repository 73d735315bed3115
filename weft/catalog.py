"""All queries outside the optional subpackage, with their SQL."""

from __future__ import annotations

from weft.queries import derived, dml, general, modules, patterns, reports, scalars, search, sources, toolbox, tools

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (general, patterns, scalars, search, derived, dml, reports, sources, modules, tools, toolbox):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
