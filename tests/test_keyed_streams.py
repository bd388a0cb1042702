"""Streams that keep state by key: restarts, replays, ids that come back, and what a batch reads."""

import datetime
import decimal
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.streaming import jobs, keyed


@pytest.fixture
def narrow(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, ddl, files=None):
    return jobs.read_files(spark, path, spark.createDataFrame([], ddl).schema, "parquet", files)


def test_fifty_batches_read_their_own_keys_only(narrow, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n in range(50):  # each batch: 20 new ids, the id of the first batch again, and a hot id many times
        put(narrow, src, [(f"k{n * 20 + i}", n) for i in range(20)] + [("k0", n)] + [("hot", n)] * 500, "k string, n int")
    query = jobs.stream_idempotent(source(narrow, src, "k string, n int", 1), "k", out, ck, order="n")
    query.awaitTermination()
    got = narrow.read.parquet(out)
    assert got.count() == 50 * 20 + 1 and got.select("k").distinct().count() == 50 * 20 + 1
    progress = [p for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    assert len(progress) == 50
    reads = [p["stateOperators"][0]["customMetrics"]["rocksdbGetCount"] for p in progress]
    # Gets are those of the batch's own keys (and of the counts of rows), whatever was seen before.
    assert max(reads[5:]) <= 2 * min(reads[5:]) and max(reads) < 100
    assert max(p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesRead"] for p in progress[40:]) <= 2 * max(
        p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesRead"] for p in progress[5:15]) + 1000
    assert not [d for d in (tmp_path / "out").iterdir() if d.is_dir() and d.name != "_spark_metadata"]


def test_restart_goes_on_and_a_replayed_batch_yields_the_same(narrow, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    start = lambda path: jobs.stream_idempotent(source(narrow, src, "k string, at timestamp"), "k", path, ck, order="at").awaitTermination()
    day = lambda d, s=0: datetime.datetime(2024, 1, d, 1, 2, 3, 1 + s)
    put(narrow, src, [("a", day(1, 5)), ("a", day(1)), ("b", day(1)), (None, day(1)), (None, day(1))], "k string, at timestamp")
    start(out)
    put(narrow, src, [("a", day(9)), ("c", day(9)), (None, day(9))], "k string, at timestamp")
    start(out)
    rows = sorted((r.k or "", r.at) for r in narrow.read.parquet(out).collect())
    assert rows == [("", day(1)), ("", day(1)), ("", day(9)), ("a", day(1)), ("b", day(1)), ("c", day(9))]
    # The driver dies after the batch was planned and before it was committed: forget that it was.
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    start(out)
    assert sorted((r.k or "", r.at) for r in narrow.read.parquet(out).collect()) == rows


def test_rows_come_back_in_their_types(narrow, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    ddl = "k bigint, big bigint, x double, d decimal(30,10), b binary, t timestamp, day date, a array<struct<s:string,n:int>>, m map<string,bigint>, s string"
    row = (7, 2**53 + 1, 0.1 + 0.2, decimal.Decimal("12345678901234567890.0123456789"), bytearray(b"\x00\xff"), datetime.datetime(2024, 2, 29, 23, 59, 59, 123456),
           datetime.date(1960, 1, 1), [("\"q\"\n", 1), (None, None)], {"z": 2**60}, "é漢\U0001f600\x01")
    put(narrow, src, [row, (8, *[None] * 9)], ddl)
    jobs.stream_idempotent(source(narrow, src, ddl), "k", out, ck).awaitTermination()
    got = {r.k: r for r in narrow.read.parquet(out).collect()}
    assert tuple(got[7])[:7] == row[:7] and [tuple(x) for x in got[7].a] == row[7] and got[7].m == row[8] and got[7].s == row[9]
    assert tuple(got[8]) == (8, *[None] * 9)


def test_ids_stored_elsewhere_are_known(narrow, tmp_path):
    src, stored, out, ck = (str(tmp_path / x) for x in ("in", "stored", "out", "ck"))
    put(narrow, stored, [("a",)], "k string")
    for rows in ([("a", 1), ("b", 1)], [("c", 2), ("b", 2)]):
        put(narrow, src, rows, "k string, n int")
        jobs.stream_idempotent(source(narrow, src, "k string, n int"), "k", out, ck, stored=source(narrow, stored, "k string")).awaitTermination()
        put(narrow, stored, [("c",)], "k string")  # another writer, between the batches
    assert sorted(r.k for r in narrow.read.parquet(out).collect()) == ["b"]


def test_an_id_stored_during_the_run_is_used_by_the_next_batch(narrow, tmp_path):
    src, stored, out, ck = (str(tmp_path / x) for x in ("in", "stored", "out", "ck"))
    ddl = "event int, user_key string"
    put(narrow, stored, [("a_1", "id-a"), ("a_1", "id-z"), ("x", None)], "user_key string, id string")

    def run():
        jobs.stream_uuid_assign(source(narrow, src, ddl), source(narrow, stored, "user_key string, id string"), out, ck).awaitTermination()
        return {r.event: r.uuid for r in narrow.read.parquet(out).collect()}

    put(narrow, src, [*((i, "a_1") for i in range(40)), (100, "b_2"), (101, None), (102, "x")], ddl)
    first = run()
    assert {first[i] for i in range(40)} == {"id-a"} and first[100] == first[100] and len(first[100]) == 36 and first[101] is None and len(first[102]) == 36
    put(narrow, stored, [("b_2", "id-b"), ("a_1", "id-0")], "user_key string, id string")
    put(narrow, src, [(200, "b_2"), (201, "a_1"), (202, "c")], ddl)
    second = run()
    assert second[200] == "id-b" and second[201] == "id-a" and second[100] == first[100] and len(second) == len(first) + 3


def test_accounts_of_a_stored_table_are_not_new(narrow, tmp_path):
    src, stored, out, ck = (str(tmp_path / x) for x in ("in", "stored", "out", "ck"))
    put(narrow, stored, [("a_1",)], "user_key string")
    for rows in ([("a", 1), ("b", 2), ("b", 2), (None, 1)], [("b", 2), ("c", 3)]):
        put(narrow, src, rows, "email string, ai_service int")
        jobs.stream_account_dedup(source(narrow, src, "email string, ai_service int"), out, ck, every=None, stored=source(narrow, stored, "user_key string")).awaitTermination()
    got = {r.user_key: r for r in narrow.read.parquet(out).collect()}
    assert {"b_2", "c_3"} <= set(got) and "a_1" not in got and got["b_2"].ai_service_id == 2 and len(got["c_3"].uuid) == 36
    shutil.rmtree(ck)


def test_settings_of_the_session_stay(narrow, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = narrow.conf.get(key, None)
    src = str(tmp_path / "in")
    put(narrow, src, [("a",)], "k string")
    jobs.stream_idempotent(source(narrow, src, "k string"), "k", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert narrow.conf.get(key, None) == before and narrow.read.parquet(str(tmp_path / "out")).where(F.col("k") == "a").count() == 1


class Messages:
    """A map state that counts the messages sent to it."""

    def __init__(self):
        self.held, self.sent = {}, 0

    def exists(self):
        self.sent += 1
        return bool(self.held)

    def getValue(self, key):  # noqa: N802
        self.sent += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.sent += 1
        self.held[key] = value


def test_keys_of_a_bucket_are_one_call_and_reads_are_of_the_batch_s_keys():
    state = Messages()
    processor = keyed._Known()
    processor.init(type("Handle", (), {"getMapState": lambda self, *_: state})())

    def call(rows):
        before = state.sent
        out = processor.handleInputRows((0, 0), iter([pd.DataFrame(rows[i:i + 300], columns=["bucket", "salt", "key", "value", "row"]) for i in range(0, len(rows), 300)]), None)
        return {r: k for pdf in out for r, k in zip(pdf["__row"], pdf["__known"])}, state.sent - before

    asked = [(0, 0, f"k{i % 1200}", None, f"r{i}") for i in range(5000)]
    told = [(0, 0, f"k{i}", v, None) for i in range(1000) for v in (f"b{i}", f"a{i}")]
    got, sent = call(asked + told)  # stored rows behind the requests, two values a key
    assert got == {f"r{i}": f"a{i % 1200}" if i % 1200 < 1000 else None for i in range(5000)} and sent == 1001
    got, sent = call([(0, 0, "k7", "0", None), (0, 0, "k7", None, "x"), (0, 0, "k8", None, "y"), (0, 0, "k8", None, "z"), (0, 0, "new", None, "n")])
    assert got == {"x": "a7", "y": "a8", "z": "a8", "n": None} and sent == 4
