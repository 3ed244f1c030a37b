"""Runs registered queries and compares them with their SQL twins in DuckDB.

``python tests/compare.py FOLDER [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {
    "bigint": {"BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"}, "float": {"FLOAT"}, "date": {"DATE"},
}


def connect(folder: str):
    import duckdb

    from wattloom.plans.views import BASE

    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return "0.0" if value == 0 else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def difference(df, con, sql: str) -> str:
    """Empty when rows, columns, types and values agree."""
    cursor = con.execute(f"SELECT * FROM ({sql}) q LIMIT 0")
    theirs = {d[0]: str(d[1]) for d in cursor.description}
    ours = dict(df.dtypes)
    if set(ours) != set(theirs):
        return f"columns: only spark {set(ours) - set(theirs)}, only sql {set(theirs) - set(ours)}"
    bad = {c: (ours[c], theirs[c]) for c in ours if theirs[c] not in TYPES.get(ours[c], {theirs[c]})}
    names = sorted(ours)
    quoted = ", ".join(f'"{n}"' for n in names)
    a = sorted(tuple(shown(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    b = sorted(tuple(shown(v) for v in row) for row in con.execute(f"SELECT {quoted} FROM ({sql}) q").fetchall())
    if bad:
        return f"types: {bad}"
    if len(a) != len(b):
        return f"rows: spark {len(a)}, sql {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"values: {len(wrong)} of {len(a)} differ\n   {names}\n   {str(wrong[0][0])[:400]}\n   {str(wrong[0][1])[:400]}"
    return "" if a else "EMPTY"


def main() -> int:
    import __spark_entry__ as e
    from wattloom.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    failed = 0
    for name, build in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun = time.time()
        try:
            df = build(spark, folder)
            if name in e.oracle_sql():
                result = difference(df, con, e.oracle_sql()[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        failed += not (result == "ok" or result.startswith("rows only"))
        print(f"{name:28s} {time.time() - begun:6.1f}s  {result}", flush=True)
    print(f"{failed} not ok")
    return failed


if __name__ == "__main__":
    sys.exit(main())
