"""Registered queries over the sketch operators, and the SQL that checks them."""

from __future__ import annotations

from . import exchange, frameworks, frequency, sliding, statistics  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
