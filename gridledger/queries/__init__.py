"""Queries over the test tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from gridledger.queries import billing, display, metering, streams

MODULES = (billing, metering, display, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
