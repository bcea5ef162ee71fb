"""Runs queries next to their SQL and compares rows: python -m workload.check <sf_dir> [name ...]"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

from sievelight.plans.session import local_session
from workload.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def cell(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return str([cell(v) for v in value])
    return value


def table(columns, rows):
    """Column names sorted, rows in an order of their own."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr(tuple(cell(r[k]) for k in order)) for r in rows)


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def types_differ(df, answer) -> str:
    """Columns whose type is spelled differently on the two sides."""
    want = {c[0]: str(c[1]) for c in answer.description}
    odd = [f"{n} {t}/{want.get(n)}" for n, t in df.dtypes if TYPES.get(t, t) != want.get(n)]
    return f"types {odd}" if odd else ""


def compare(spark, db, name: str, sf_dir: str) -> tuple[bool, int, str]:
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    if name not in ORACLES:
        return True, len(got[1]), "no SQL"
    answer = db.execute(ORACLES[name])
    note = types_differ(df, answer)
    want = table([c[0] for c in answer.description], answer.fetchall())
    if got == want:
        return True, len(got[1]), note
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} want {want[0]}"
    extra, lacking = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return False, len(got[1]), f"{len(want[1])} wanted; extra {sorted(extra)[:2]} lacking {sorted(lacking)[:2]}"


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = local_session(cores=8, partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            ok, rows, note = compare(spark, db, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, rows, note = False, -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28} {rows:7} rows {time.time() - start:6.1f}s {note[:900]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
