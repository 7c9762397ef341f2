"""Demonstration queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import catalogue, checks, files, findings, measures, operations, reports, signals, usage

_ALL = {**findings.QUERIES, **catalogue.QUERIES, **checks.QUERIES, **usage.QUERIES, **files.QUERIES, **signals.QUERIES, **operations.QUERIES, **measures.QUERIES, **reports.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
