"""Bucketed tables: what a change reads and writes, and what a failed one leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators.accounts import latest_by_key
from sieveline.sources import keyed_table as K
from sieveline.sources import sinks

DDL = "k string, n bigint, s string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def content(table):
    return sorted((r.k or "", r.n, r.s) for r in table.rows().collect())


def table_of(spark, tmp_path, rows, buckets=32):
    df = frame(spark, rows)
    table = K.KeyedTable(spark, str(tmp_path / "t"), "k", df.schema, buckets)
    table.rewrite(df, lambda stored, new: latest_by_key(stored, new, "k", "n"))
    return table


def test_bloom_filters_never_miss():
    rng = np.random.default_rng(1)
    held, others = rng.integers(-2**63, 2**63, 5000), rng.integers(-2**63, 2**63, 20_000)
    bloom = K.bloom_filter(held)
    assert all(K.bloom_may_hold(bloom, held[i:i + 1]) for i in range(0, 5000, 7)) and not K.bloom_may_hold(K.bloom_filter(held[:0]), held)
    assert sum(K.bloom_may_hold(bloom, others[i:i + 1]) for i in range(2000)) < 40


def test_an_upsert_rewrites_the_touched_buckets_only(spark, tmp_path):
    rows = [(f"k{i}", 1, "old") for i in range(3000)]
    table = table_of(spark, tmp_path, rows)
    before = {e.file for e in table.entries()[1]}
    assert len({f.split("/")[2] for f in before}) == 32
    new = frame(spark, [("k7", 2, "new"), ("k7", 3, "newer"), ("fresh", 1, "new"), ("k8", 0, "stale")])
    sinks.sink_upsert_latest(new, table.path, table.path, "k", "n", buckets=32)
    after = {e.file for e in table.entries()[1]}
    touched = {r[0] for r in new.select(table.bucket()).distinct().collect()}
    assert len(touched) <= 3 and {e[K.BUCKET] for e in table.entries()[1] if e.file not in before} == touched and len(before & after) == 32 - len(touched)
    want = {k: (n, s) for k, n, s in rows} | {"k7": (3, "newer"), "fresh": (1, "new")}
    assert content(table) == sorted((k, *v) for k, v in want.items())


def test_a_failed_run_leaves_the_table_readable(spark, tmp_path):
    table = table_of(spark, tmp_path, [("a", 1, "x"), ("b", 1, "x"), (None, 1, "x")])
    boom = F.when(F.col("k") == "a", F.raise_error(F.lit("boom"))).otherwise(F.col("s"))
    with pytest.raises(Exception, match="boom"):
        table.rewrite(frame(spark, [("a", 2, "y")]), lambda stored, new: stored.unionByName(new).withColumn("s", boom))
    assert content(table) == [("", 1, "x"), ("a", 1, "x"), ("b", 1, "x")] and table.entries()[0] == 1
    # Written, but the manifest was not: the next run takes the same folder.
    commit, table._commit = table._commit, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        table.rewrite(frame(spark, [("b", 5, "lost")]), lambda stored, new: latest_by_key(stored, new, "k", "n"))
    table._commit = commit
    assert content(table) == [("", 1, "x"), ("a", 1, "x"), ("b", 1, "x")]
    table.rewrite(frame(spark, [("a", 9, "z")]), lambda stored, new: latest_by_key(stored, new, "k", "n"))
    assert content(table) == [("", 1, "x"), ("a", 9, "z"), ("b", 1, "x")]
    with pytest.raises(Exception, match="(?i)exists"):
        table._commit(2, [])


def test_appending_opens_the_files_that_may_hold_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    for part in range(4):
        table = sinks.sink_idempotent_create(frame(spark, [(f"k{part * 1000 + i}", part, "x") for i in range(1000)]), path, "k", "n", buckets=8)
    files = len(table.entries()[1])
    assert files == 32
    table = sinks.sink_idempotent_create(frame(spark, [(f"new{i}", 1, "x") for i in range(5)] + [("k1500", 9, "again"), (None, 1, "x"), (None, 1, "x")]), path, "k", "n", buckets=8)
    assert 1 <= len(table.opened) <= 4, table.opened
    rows = content(table)
    assert len(rows) == 4000 + 5 + 2 and ("k1500", 1, "x") in rows
    again = sinks.sink_idempotent_create(frame(spark, [("k1500", 9, "again"), ("k3999", 9, "again")]), path, "k", "n", buckets=8)
    assert content(again) == rows and len(again.opened) <= 4
    assert sinks.sink_idempotent_create(frame(spark, []), path, "k", "n", buckets=8).opened == [] and content(table) == rows


def test_files_of_a_bucket_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "FANOUT", 3)
    path, most = str(tmp_path / "t"), 0
    for n in range(14):
        table = sinks.sink_idempotent_create(frame(spark, [(f"k{n}_{i}", n, "x") for i in range(6)]), path, "k", buckets=2)
        by_bucket = [sum(e[K.BUCKET] == b for e in table.entries()[1]) for b in range(2)]
        most = max(most, *by_bucket)
    assert most <= 2 * 3 and len(content(table)) == 14 * 6  # two files of each of three levels
    assert table.vacuum() > 0 and len(content(table)) == 14 * 6 and table.vacuum() == 0
    assert sinks.sink_idempotent_create(frame(spark, [("k0_0", 1, "y")]), path, "k", buckets=2).rows().count() == 14 * 6
