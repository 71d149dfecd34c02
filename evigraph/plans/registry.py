"""All registered core queries and their SQL equivalents."""

from __future__ import annotations

from . import extraction, graphs, integrity, layers, state, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (integrity, layers, tables, graphs, extraction, state):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
