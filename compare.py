"""Run queries against their SQL twins: python compare.py [folder] [name-prefix ...]."""

import sys
import time

import duckdb
import pandas as pd

from tandem.catalog import QUERIES, SQL
from tandem.catalog.base import TABLES
from tandem.session import session


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: [_cell(v) for v in df[c]] for c in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.8f}".replace("-0.00000000", "0.00000000")
    return str(v)


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def check(spark, con, folder: str, name: str) -> tuple[bool, str]:
    got = QUERIES[name](spark, folder)
    pdf = got.toPandas()
    if name not in SQL:
        return len(pdf) > 0, f"rows only: {len(pdf)}"
    want = con.execute(SQL[name]).df()
    if sorted(want.columns) != sorted(pdf.columns):
        return False, f"columns {sorted(pdf.columns)} vs {sorted(want.columns)}"
    a, b = norm(pdf), norm(want)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return False, f"{int(bad.sum())} of {len(a)} rows differ\n{a[bad].head(4)}\n{b[bad].head(4)}"
    return len(a) > 0, f"{len(a)} rows"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    spark = session("local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), []
    for name in [q for q in QUERIES if not sys.argv[2:] or any(q.startswith(p) for p in sys.argv[2:])]:
        t0 = time.time()
        try:
            ok, text = check(spark, con, folder, name)
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += [] if ok else [name]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {text}", flush=True)
    print(f"{len(bad)} failed: {bad}")
