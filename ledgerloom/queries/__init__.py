"""The catalogue: each query on the fixture tables, and its SQL for DuckDB."""

from __future__ import annotations

from . import archive, boards, framing, importing, journal, monthly, paperwork, relational, reports, retrieval, sheets, story, summary

MODULES = (relational, reports, boards, journal, retrieval, archive, importing, paperwork, story, framing, monthly, sheets, summary)
QUERIES = {name: f for m in MODULES for name, f in m.BOOK.queries.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.BOOK.sql.items()}
