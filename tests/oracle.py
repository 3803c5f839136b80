"""Compare registered queries with their SQL on DuckDB."""
from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int = 8, **extra):
    from pyspark.sql import SparkSession

    b = (SparkSession.builder.master(f"local[{cpus}]").appName("tidemark").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR"))
    for k, v in extra.items():
        b = b.config(k, v)
    return b.getOrCreate()


def duck(folder: str):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
                out.append("NULL")
            elif hasattr(v, "item"):
                out.append(repr(v.item()))
            else:
                out.append(repr(v))
        rows.append(tuple(out))
    return sorted(rows)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def compare(name, run, sql, spark, folder, con) -> str:
    t = time.time()
    got = run(spark, folder).toPandas()
    took = time.time() - t
    if sql is None:
        return f"rows={len(got)} {took:.1f}s NO-ORACLE" if len(got) else f"EMPTY {took:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"FAIL rows {len(a)} vs {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"FAIL values {len(bad)}/{len(a)} cols={sorted(got.columns)} e.g. {bad[:2]}"
    note = "" if kinds(got) == kinds(want) else f" KINDS {[(c, k, kinds(want)[c]) for c, k in kinds(got).items() if k != kinds(want)[c]]}"
    return ("OK" if len(a) else "EMPTY") + f" rows={len(a)} {took:.1f}s{note}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    extra = {"spark.tidemark.rowsPerTask": os.environ["ROWS_PER_TASK"]} if "ROWS_PER_TASK" in os.environ else {}
    spark, con = session(**extra), duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in sorted(entry.queries().items()):
        if len(sys.argv) > 1 and not any(name.startswith(a) for a in sys.argv[1:]):
            continue
        try:
            verdict = compare(name, run, oracles.get(name), spark, folder, con)
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += verdict.startswith(("FAIL", "ERROR", "EMPTY"))
        print(f"{name:40s} {verdict}", flush=True)
    print("problems:", bad)
