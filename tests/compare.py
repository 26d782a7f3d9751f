"""Run a query in Spark and its SQL in DuckDB and compare rows. ``python tests/compare.py SF NAME...``"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return con


def tidy(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return "~"
        if isinstance(v, pd.Timestamp) and v == v.normalize():
            return str(v)[:10]
        if isinstance(v, float):
            return "~" if v != v else f"{v:.9g}"
        if hasattr(v, "item") and not hasattr(v, "__len__"):
            return cell(v.item())
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, int):
            return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
        return str(list(v)) if hasattr(v, "tolist") else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> str:
    began = time.time()
    got = query(spark, sf_dir).toPandas()
    took = time.time() - began
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    want = duck(sf_dir).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: MISMATCH columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = tidy(got), tidy(want)
    if a != b:
        extra, lost = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"{name}: MISMATCH {len(a)} / {len(b)} rows; only here {extra}; only in SQL {lost}"
    return f"{name}: equal, {len(a)} rows, {took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tonewright.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    q, o = entry.queries(), entry.oracle_sql()
    sf, names = sys.argv[1], sys.argv[2:] or sorted(q)
    for n in [x for x in q if any(x == a or a.endswith("*") and x.startswith(a[:-1]) for a in names)]:
        try:
            print(compare(spark, f"/root/testdata/{sf}", n, q[n], o.get(n)), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{n}: ERROR {str(e)[:1500]}", flush=True)
