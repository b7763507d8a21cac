"""Run registered queries in Spark and their SQL oracles in DuckDB; compare results.

usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's gate: row count, column names, and order-insensitive values.
"""
from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for r in pdf[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in r))
    return cols, sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from roomgrid.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(spdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            dpdf = con.execute(sqls[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows_of(spdf)
        dc, dr = rows_of(dpdf)
        types = (list(zip(sdf.columns, [f.dataType.simpleString() for f in sdf.schema])),
                 list(zip(dpdf.columns, [str(t) for t in con.execute(sqls[name]).description and [d[1] for d in con.execute(sqls[name]).description]])))
        if sc != dc:
            print(f"FAIL {name}: columns {sc} vs {dc}")
            bad += 1
        elif len(sr) != len(dr):
            print(f"FAIL {name}: rows {len(sr)} vs {len(dr)}")
            bad += 1
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            print(f"FAIL {name}: values differ, e.g. {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(sr)} rows {ts:.1f}s  types={types[0]} | {types[1]}")
    print("bad:", bad)


if __name__ == "__main__":
    main()
