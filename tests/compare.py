"""Run queries on Spark and their SQL on DuckDB and compare: python tests/compare.py FOLDER [NAME...]."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return "null" if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, folder, name, query, sql):
    """The number of rows if both agree, else raises."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got)
    res = con.execute(sql)
    columns, rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(columns) == sorted(df.columns), f"{name}: {sorted(df.columns)} {sorted(columns)}"
    want = rows_of(columns, rows)
    a, b = set(got), set(want)
    assert got == want, f"{name}: {len(got)} and {len(want)} rows; only Spark {sorted(a - b)[:5]}; only SQL {sorted(b - a)[:5]}"
    return len(got)


if __name__ == "__main__":
    import __spark_entry__ as e
    from tests.conftest import session

    spark, folder = session(), sys.argv[1]
    con, bad = connect(folder), 0
    for n in sys.argv[2:] or e.queries():
        t = time.time()
        try:
            k = compare(spark, con, folder, n, e.queries()[n], e.oracle_sql().get(n))
            print(f"{n}: {k} rows, {'equal' if n in e.oracle_sql() else 'no SQL'}, {time.time() - t:.1f} s", flush=True)
        except Exception as x:
            bad += 1
            print(f"{n}: FAILED {str(x)[:1500]}", flush=True)
    sys.exit(bad > 0)
