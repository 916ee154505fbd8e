"""Run a registered query in Spark and its SQL in DuckDB and compare the results.

``python -m tests.compare [sf or folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def kind(series: pd.Series) -> str:
    values = [v for v in series.tolist() if v is not None and not (isinstance(v, float) and np.isnan(v))]
    if not values:
        return "empty"
    return {bool: "bool", np.bool_: "bool", int: "int", float: "float", str: "str"}.get(type(values[0]), type(values[0]).__name__)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    keys = df.map(lambda v: f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.loc[keys.sort_values(list(keys.columns)).index].reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> list[str]:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(sql_df.columns)}"]
    if len(spark_df) != len(sql_df):
        return [f"{len(spark_df)} rows against {len(sql_df)}"]
    a, b = normal(spark_df), normal(sql_df)
    out = []
    for c in a.columns:
        ka, kb = kind(spark_df[c]), kind(sql_df[c])
        if "empty" not in (ka, kb) and ka != kb:
            out.append(f"{c}: type {ka} against {kb}")
        bad = [(x, y) for x, y in zip(a[c], b[c]) if x != y]
        if bad:
            out.append(f"{c}: {len(bad)} values differ, e.g. {bad[:3]}")
    return out


def main(argv: list[str]) -> int:
    from framelens.session import local_session
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.001"
    names = argv[1:]
    sf_dir = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows {name} {len(got)} {took:.2f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(sql[name]).df()
            problems = differences(got, want)
            state = "FAIL" if problems else "ok"
            failed += bool(problems)
            print(f"{state} {name} rows={len(got)} spark={took:.2f}s duck={time.time() - start:.2f}s {problems or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERR {name} {str(error)[:600]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
