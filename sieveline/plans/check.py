"""Compare registered queries with their SQL twins: ``python -m sieveline.plans.check [sf_dir] [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def norm(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        return str(v)

    cols = sorted(frame.columns)
    return sorted((tuple(norm(v) for v in row) for row in frame[cols].itertuples(index=False)), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    from sieveline.plans import ORACLES, QUERIES

    started = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - started
    if name not in ORACLES:
        return f"rows-only {len(got)} rows {took:.1f}s"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return f"ok {len(a)} rows {took:.1f}s" + (" EMPTY" if not a else "")
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    return f"DIFF rows {len(a)}/{len(b)} spark-only {len(only_a)} {only_a[:2]} sql-only {len(only_b)} {only_b[:2]}"


def main() -> None:
    from sieveline.plans import QUERIES
    from sieveline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    for name in names:
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as err:  # noqa: BLE001 - show and go on
            result = f"ERROR {type(err).__name__}: {str(err)[:600]}"
        print(f"{name}: {result[:900]}", flush=True)


if __name__ == "__main__":
    main()
