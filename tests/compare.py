"""python tests/compare.py FOLDER NAME... : each query beside its SQL, as the driver compares them."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    from decimal import Decimal

    def plain(v):
        if isinstance(v, Decimal):
            return float(v)
        if isinstance(v, float):
            return None if v != v else (0.0 if v == 0 else v)
        return v

    return sorted([tuple(plain(r[i]) for i in order) for r in records], key=repr)


def compare(spark, name, folder):
    import __spark_entry__ as e

    t = time.time()
    df = e.queries()[name](spark, folder)
    got = rows_of(df.collect(), df.columns)
    took = time.time() - t
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s", True
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(folder).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    t = time.time()
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), names)
    same = got == want and sorted(names) == sorted(df.columns)
    text = f"{name}: {'same' if same else 'DIFFERENT'} {len(got)} rows, SQL {len(want)}, {took:.1f} s, SQL {time.time() - t:.1f} s"
    if not same:
        if sorted(names) != sorted(df.columns):
            text += f"\n  columns {sorted(df.columns)} SQL {sorted(names)}"
        a, b = set(map(repr, got)), set(map(repr, want))
        text += f"\n  only here ({len(a - b)}): {sorted(a - b)[:4]}\n  only SQL ({len(b - a)}): {sorted(b - a)[:4]}"
    return text, same


if __name__ == "__main__":
    from riverspark.session import build_session

    spark = build_session(int(os.environ.get("BENCH_CPUS", "8")))
    import __spark_entry__ as e

    bad = 0
    for n in sys.argv[2:] or list(e.queries()):
        try:
            text, same = compare(spark, n, sys.argv[1])
        except Exception as x:  # noqa: BLE001
            text, same = f"{n}: ERROR {type(x).__name__} {str(x)[:1500]}", False
        bad += not same
        print(text, flush=True)
    print("bad:", bad)
