"""Runs registered queries and their SQL checks side by side.

    python tests/compare.py [scale] [name ...]
"""

from __future__ import annotations

import io
import math
import os
import sys
import time
from contextlib import redirect_stdout

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sf_dir(scale: str) -> str:
    return f"/root/testdata/sf{scale}"


def duck(scale: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir(scale)}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.10g}" if v else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def table(columns, rows):
    """Columns sorted by name, rows sorted, cells as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def plan(df):
    """The formatted physical plan as text."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def spark_table(df):
    rows = df.collect()
    return table(df.columns, [tuple(r) for r in rows]), dict(df.dtypes)


# Type names of both engines that hold the same values.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def duck_table(con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    return table(names, res.fetchall()), types


def type_differences(spark_types, duck_types):
    return {
        n: (t, duck_types.get(n))
        for n, t in spark_types.items()
        if t in SAME_TYPE and duck_types.get(n) != SAME_TYPE[t]
    }


def main(argv):
    scale = argv[0] if argv else "0.01"
    from __spark_entry__ import oracle_sql, queries
    from tablelens.session import local_session

    spark = local_session(8)
    names = argv[1:] or list(queries())
    con, bad = duck(scale), []
    for name in names:
        start = time.time()
        try:
            (cols, rows), types = spark_table(queries()[name](spark, sf_dir(scale)))
        except Exception as e:
            bad.append(name)
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        sql = oracle_sql().get(name)
        if sql is None:
            print(f"rows  {name}: {len(rows)} rows, {took:.1f}s", flush=True)
            continue
        try:
            (dcols, drows), dtypes = duck_table(con, sql)
        except Exception as e:
            bad.append(name)
            print(f"SQLERR {name}: {str(e)[:800]}", flush=True)
            continue
        off = type_differences(types, dtypes)
        if (cols, rows) == (dcols, drows) and not off:
            print(f"ok    {name}: {len(rows)} rows, {took:.1f}s", flush=True)
            continue
        bad.append(name)
        print(f"DIFF  {name}: {len(rows)} vs {len(drows)} rows; columns {cols} vs {dcols}; types {off}")
        a = [r for r in rows if r not in set(drows)][:4]
        b = [r for r in drows if r not in set(rows)][:4]
        print("   spark:", a, "\n   duck: ", b, flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} good; not good: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
