"""Run registered queries against their SQL: python -m tests.check [folder] [name ...]."""

from __future__ import annotations

import datetime
import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 12) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cleaned, key=repr)


def compare(spark, con, folder, fn, sql):
    """(row count, differences)."""
    made = fn(spark, folder)
    mine = rows_of(made.columns, [tuple(r) for r in made.collect()])
    if sql is None:
        return len(mine[1]), None
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = rows_of(names, result.fetchall())
    problems = []
    if mine[0] != theirs[0]:
        problems.append(f"columns {mine[0]} / {theirs[0]}")
    elif mine[1] != theirs[1]:
        left, right = set(map(repr, mine[1])), set(map(repr, theirs[1]))
        problems.append(f"rows {len(mine[1])} / {len(theirs[1])}; only here {sorted(left - right)[:3]}; only there {sorted(right - left)[:3]}")
    families = {"int": "int", "bigint": "int", "double": "float", "string": "str", "boolean": "bool"}
    kinds = {"INTEGER": "int", "BIGINT": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
    sizes = {"int": "INTEGER", "bigint": "BIGINT"}
    duck = {c[0]: str(c[1]) for c in result.description}
    for name, kind in made.dtypes:
        other = duck.get(name, "")
        if families.get(kind) != kinds.get(other) and (kind in families or other in kinds):
            problems.append(f"type of {name}: {kind} / {other}")
        elif kind in sizes and sizes[kind] != other:
            problems.append(f"width of {name}: {kind} / {other}")
    return len(mine[1]), problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from lintlake.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(scratch=tempfile.mkdtemp(prefix="run-"))
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            n, problems = compare(spark, con, folder, fn, sql.get(name))
        except Exception as problem:  # noqa: BLE001
            n, problems = -1, [f"{type(problem).__name__}: {str(problem)[:700]}"]
        state = "rows only" if problems is None else "ok" if not problems else "DIFFERS " + " | ".join(problems)
        bad += bool(problems)
        print(f"{name:28s} {n:7d} rows {time.time() - start:6.1f}s {state}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
