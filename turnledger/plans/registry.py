"""All queries of the usage engine by name, with their SQL."""

from __future__ import annotations

from . import core, formats, intake, lookups, report, sharing, tasks, texts

MODULES = (core, intake, formats, report, texts, tasks, lookups, sharing)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
