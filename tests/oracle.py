"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

# The supplied tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a text about the first difference."""
    frame = query(spark, sf_dir)
    got = frame.collect()
    if sql is None:
        return None if got else "no rows"
    relation = con.execute(sql)
    columns = [c[0] for c in relation.description]
    want = relation.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    ours, theirs = _rows(frame.columns, got), _rows(columns, want)
    if not ours:
        return "no rows"
    types = {n: str(t) for n, t, *_ in relation.description}
    for field in frame.schema:
        kind = field.dataType.simpleString()
        expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kind)
        if expected and types[field.name] not in (expected, "NUMBER", "STRING", "bool") and types[field.name] != expected:
            return f"type of {field.name}: {kind} != {types[field.name]}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    names = sorted(columns)
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b and not _near(a, b)]
    if bad:
        a, b = bad[0]
        diff = {n: (x, y) for n, x, y in zip(names, a, b) if x != y}
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {diff} in {a}"
    close = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if not close:
        return None
    diff = {n: (x, y) for n, x, y in zip(names, *close[0]) if x != y}
    return f"~ {len(close)} of {len(ours)} rows equal only within 1e-6, e.g. {diff}"


def _near(a, b):
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6))
        for x, y in zip(a, b)
    )


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from flowspark.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("oracle", 8)
    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        began = time.time()
        try:
            result = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as exc:  # report and go on to the next query
            result = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += bool(result)
        note = "" if name in sql else " (rows only)"
        print(f"{'FAIL' if result else 'ok  '} {name}{note} {time.time() - began:.1f}s {result or ''}", flush=True)
    print(f"{failed} failed of {len(argv[1:] or queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
