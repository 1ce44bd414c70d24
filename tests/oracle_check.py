"""Compare catalogue queries with their SQL in DuckDB: python tests/oracle_check.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(dtype.kind, "obj")


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str), kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if len(a) and kind(a[c].dtype) != kind(b[c].dtype):
            # pandas holds whole numbers with gaps as floats.
            if {kind(a[c].dtype), kind(b[c].dtype)} == {"int", "float"} and (a[c].isna().any() or b[c].isna().any()):
                if not a[c].astype("float64").equals(b[c].astype("float64")):
                    return f"values of {c}"
                continue
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        x, y = a[c].astype(str), b[c].astype(str)
        x, y = x.replace({"None": "nan", "<NA>": "nan", "NaN": "nan"}), y.replace({"None": "nan", "<NA>": "nan", "NaN": "nan"})
        bad = x != y
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c}, first: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from relyframe.session import build_session

    args = sys.argv[1:]
    root = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    spark = build_session(
        master="local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(root), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, root).toPandas()
            took = time.time() - t0
            if name not in sqls:
                print(f"ROWS {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            t1 = time.time()
            diff = differences(got, con.execute(sqls[name]).df())
            print(f"{'OK  ' if diff is None else 'DIFF'} {name} {len(got)} rows {took:.1f}s / sql {time.time()-t1:.1f}s {diff or ''}", flush=True)
            failed += diff is not None
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
