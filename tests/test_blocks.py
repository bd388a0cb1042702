import os

import pyarrow as pa
from pyspark.sql import functions as F

from sieveline.functions.blocks import in_blocks
from sieveline.operators import files as FI
from sieveline.plans import QUERIES
from sieveline.plans.decisions import _zipped


def test_blocks_end_by_bytes_and_lose_nothing():
    words = ["abc", None, "", "defgh", "ij", None, "k"]
    batches = [(pa.array(words), pa.array(range(7))), (pa.array([], pa.string()), pa.array([], pa.int64())), (pa.array(["z" * 9]), pa.array([7]))]
    seen = []
    got = list(in_blocks(batches, lambda w, i: seen.append(i) or w, pa.string(), lambda w: len(w or ""), limit=6))
    assert [a.to_pylist() for a in got] == [["abc", None, "", "defgh"], ["ij", None, "k"], ["z" * 9]] and seen == list(range(8))


def test_a_worker_does_not_hold_the_texts_of_a_batch(spark):
    def grown(content: bytes) -> str:
        """The worker's memory in MB, and a megabyte of text."""
        with open("/proc/self/statm") as f:
            return f"{int(f.read().split()[1]) * os.sysconf('SC_PAGE_SIZE') >> 20}|" + "x" * (1 << 20)

    given = spark.range(300, numPartitions=1).select(F.col("id").alias("path"), F.lit("text/x").alias("mime_type"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    rows = FI.extract_file_text(given, extractors={"text/x": grown}).select("path", F.split("text", r"\|")[0].cast("int").alias("mb"), F.length("text").alias("n")).collect()
    assert sorted(r.path for r in rows) == list(range(300)) and min(r.n for r in rows) > 1 << 20
    used = [r.mb for r in rows]
    assert max(used) - min(used) < 100


def test_files_are_made_once_whatever_is_asked_of_the_result(spark):
    made = spark.sparkContext.accumulator(0)
    kinds = {0: _zipped("a\nb"), 1: "é".encode(), 2: b"\x7fELF....", 3: None, 4: b"PK\x03\x04word/", 5: b""}

    @F.udf("binary")
    def make(i):
        made.add(1)
        return kinds[i % 6]

    source = spark.range(60, numPartitions=2).select(F.col("id").alias("path"), make("id").alias("content")).withColumn("mime_type", FI.sniff_mime(F.col("content")))
    done = FI.extract_file_text(source)
    assert done.columns == ["path", "text", "error"]
    got = {r.path: (r.text, r.error) for r in done.where(F.col("error").isNull() | F.col("text").isNull()).collect()}
    assert made.value == 60
    elf, broken = "unsupported file type application/x-executable", "File is not a zip file"
    assert got == {i: (("a\nb", None), ("é", None), (None, elf), (None, None), (None, broken), ("", None))[i % 6] for i in range(60)}


def test_documents_without_text_stay_rows(spark, tmp_path):
    rows = [(1, "en", "s", "a <b> & c\nd"), (2, "en", "s", None), (3, "en", "s", ""), (4, "de", "s", "é" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: (r.digest, r.error) for r in QUERIES["extract_zip_text"](spark, str(tmp_path)).collect()}
    want = {f"/f/{i}": (spark.range(1).select(F.md5(F.lit(t))).first()[0], None) for i, _, _, t in rows}
    assert got == want
