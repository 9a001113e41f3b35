"""Registered queries of the point-in-time engine, with the same queries in SQL."""

from __future__ import annotations


def queries() -> dict:
    from . import archives, pit, streams  # noqa: F401  they register with pit

    return pit.QUERIES


def oracle_sql() -> dict:
    from . import archives, pit, streams  # noqa: F401

    return pit.ORACLE_SQL
