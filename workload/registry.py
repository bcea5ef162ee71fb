"""All queries and their SQL."""

from __future__ import annotations

from workload import items, logs, readback, rows, scores, texts

FAMILIES = (logs, rows, scores, texts, items, readback)
QUERIES = {name: fn for family in FAMILIES for name, (fn, _) in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
