"""Queries over the driver's tables, with the SQL that they are held against."""

from __future__ import annotations

from . import architecture, history, rework, source

QUERIES: dict = source.QUERIES | history.QUERIES | architecture.QUERIES | rework.QUERIES
ORACLES: dict = source.ORACLES | history.ORACLES | architecture.ORACLES | rework.ORACLES
