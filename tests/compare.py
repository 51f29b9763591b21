"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def frame(df):
    import pandas as pd

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6) + 0.0
        elif str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].dt.tz_localize(None) if df[c].dt.tz is not None else df[c]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).astype(str).values.tolist()))


def views(d):
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def compare(spark, c, d, name, query, sql):
    t = time.time()
    got = query(spark, d).toPandas()
    took = time.time() - t
    if sql is None:
        return f"rows {len(got)}", took, True
    want = c.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}", took, False
    a, b = frame(got), frame(want)
    if a == b:
        return f"equal {len(a)}", took, True
    extra, lost = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"DIFFERENT {len(a)} {len(b)} {extra} {lost}", took, False


if __name__ == "__main__":
    import __spark_entry__ as e

    from querypond.runtime import session

    spark = session(shuffle_partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    c, d = views(sys.argv[1]), sys.argv[1]
    qs, sqls = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or qs:
        try:
            text, took, _ = compare(spark, c, d, n, qs[n], sqls.get(n))
        except Exception as x:  # noqa: BLE001
            text, took = f"ERROR {type(x).__name__} {str(x)[:600]}", 0
        print(f"{n}: {text[:700]} ({took:.1f} s)", flush=True)
