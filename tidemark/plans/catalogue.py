"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import features, market, quality, sessions, studies

QUERIES, ORACLE_SQL = {}, {}
for _part in (market, quality, sessions, studies, features):
    QUERIES |= _part.C.queries
    ORACLE_SQL |= _part.C.sql
