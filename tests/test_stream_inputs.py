"""Streams over tables that are one file and over tables that are a folder of files."""

import duckdb
import pytest

from sieveline.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folders(spark, tmp_path):
    """The tables the streams read, each as a folder of several files."""
    for name in ("documents", "events", "customer"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_filter", "stream_uuid_assign", "stream_idempotent"])
def test_a_table_may_be_a_folder_of_files(spark, folders, name):
    got = sorted(tuple(r) for r in QUERIES[name](spark, folders).collect())
    with duckdb.connect() as db:
        for table in ("documents", "events", "customer"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        assert got == sorted(db.execute(ORACLES[name]).fetchall())
