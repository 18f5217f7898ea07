"""The engine's queries over the test tables, by family: each module has QUERIES and, for most, ORACLE (DuckDB SQL)."""

from __future__ import annotations

from . import chunks, files, grids, ground, ingest, jobs, pages, pdf, search, sql, stream, tables

FAMILIES = (chunks, ground, tables, grids, pages, pdf, files, search, jobs, ingest, sql, stream)


def queries() -> dict:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
