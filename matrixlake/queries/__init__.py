"""Queries on the driver's tables, one or more for each operator, and the SQL that must give the same rows.

The tables stand in for a corpus: line items are counts (order = cell, part =
feature, quantity = count), return flags are datasets, orders are cells' metadata.
"""

from __future__ import annotations

from matrixlake.queries import axes, canonical, matrix, pairs, stored, texts

_PARTS = (matrix, axes, pairs, texts, canonical, stored)


def queries() -> dict:
    return {k: q for p in _PARTS for k, (q, _) in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for p in _PARTS for k, (_, sql) in p.QUERIES.items() if sql}
