"""Files in byte ranges against whole reads."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.operators import files as FI
from sieveline.operators.rules import as_rules
from sieveline.sources import file_chunks as FC
from sieveline.sources import readers

RULES = [("word", r"\bneedle\b", "block", 0, None), ("span", r"alpha\s+beta", "masking", 0, None), ("hangul", "비밀번호", "masking", 0, None)]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(6)
    words = ["needles", "alpha", "gamma", "한글", "é", "비밀", "번호", "\n", "x"]
    for i in range(30):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 400)))
        if i % 4 == 1:
            at = rng.randrange(0, len(text) + 1)
            text = text[:at] + rng.choice([" needle ", " alpha \n beta ", " 비밀번호 "]) + text[at:]
        (tmp_path / f"f{i}.txt").write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.txt").write_bytes("alpha beta".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"needle")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4 needle")
    (tmp_path / "o.docx").write_bytes(b"PK\x03\x04" + b"." * 100 + b"word/" + b"." * 100)
    (tmp_path / "nul.bin").write_bytes(b"a\0needle")
    (tmp_path / "cut.bin").write_bytes("é".encode()[:1])
    return tmp_path


@pytest.mark.parametrize("chunk, overlap", [(1, 0), (7, 4), (64, 32), (100, 1000), (1 << 20, 64)])
def test_every_byte_is_in_one_chunk(spark, folder, chunk, overlap):
    got = {}
    for r in FC.scan_chunks(spark, str(folder), chunk=chunk, overlap=overlap, split=256).collect():
        whole = open(r.path[5:], "rb").read()
        assert r.length == len(whole) and bytes(r.content) == whole[r.start - r.lead:r.start - r.lead + len(r.content)]
        assert r.lead >= min(r.start, overlap - overlap // 2) and len(r.content) >= r.lead + r.stop - r.start
        got.setdefault(r.path, []).append((r.start, r.stop))
    for path, parts in got.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] == len(open(path[5:], "rb").read())
    assert len(got) == sum(1 for p in folder.rglob("*") if p.is_file() and p.stat().st_size and p.name != "_hidden")


def test_digests_equal_whole_reads(spark, folder):
    whole = readers.scan_attachments(spark, str(folder)).select("path", "length", F.sha2("content", 256).alias("hash"), FI.sniff_mime(F.col("content")).alias("mime"))
    more = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).where("path like '%/sub/%'").select(
        "path", "length", F.sha2("content", 256).alias("hash"), FI.sniff_mime(F.col("content")).alias("mime"))
    got = FC.scan_digests(spark, str(folder), chunk=5).select("path", "length", "hash", FI.mime_of(F.col("head"), F.col("office"), F.col("plain")).alias("mime"))
    assert sorted(got.where("length > 0").collect()) == sorted(whole.unionByName(more).where("path not like '%\\_hidden'").collect())
    empty = got.where("length = 0").first()  # the whole-file reader leaves empty files out
    assert (empty.hash, empty.mime) == (hashlib.sha256().hexdigest(), "text/plain")


@pytest.mark.parametrize("chunk", [40, 333, 1 << 20])
def test_verdicts_equal_those_of_whole_files(spark, folder, chunk):
    rules, allow = as_rules(RULES), ("unknown", "doc", "docx", "pdf")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).where("path not like '%\\_hidden'")
    whole = FI.scan_files(found.withColumn("message_id", F.lit("m")), rules, allow, 1500).select("path", "action", "policy_id", "policy_name", "file_info")
    got = FI.scan_large_files(spark, str(folder), rules, allow_ext=allow, max_size=1500, chunk=chunk, overlap=128, split=1 << 12)
    plain = "file_info.mime_type = 'text/plain' and file_info.size > 0"
    empty = got.where("file_info.size = 0").first()
    assert (empty.action, empty.error, empty.file_info.chunk) == ("", None, "")
    assert sorted(got.where(plain).select(*whole.columns).collect()) == sorted(whole.where(plain).collect())
    assert {r.action for r in got.where(plain).collect()} == {"", "block", "masking"}
    others = {r.path.rsplit("/", 1)[1]: (r.action, r.error) for r in got.where("file_info.mime_type <> 'text/plain'").collect()}
    assert others["p.pdf"] == (C.BLOCK, "unsupported file type application/pdf") and set(others) == {"p.pdf", "o.docx", "nul.bin", "cut.bin"}


def test_rules_that_need_the_whole_text_are_refused(spark, folder):
    for rule in (r"^a", r"a$", r"(?m)^x", r"(b|(?:c\Z))", r"(?<!a)b", r"(x(?=y))+"):
        with pytest.raises(ValueError, match="whole text: r"):
            FI.scan_large_files(spark, str(folder), as_rules([("r", rule, "block", 0, None)]))
    for rule in (r"\ba\b", r"[^a]b", r"(a|b)+?\Bc", r"a{2,3}"):
        FI.scan_large_files(spark, str(folder), as_rules([("r", rule, "block", 0, None)]))


def test_a_file_larger_than_a_cell(spark, tmp_path):
    size = (1 << 31) + 12_345
    with open(tmp_path / "large.bin", "wb") as out:
        out.truncate(size)
        out.seek(size - 100)
        out.write(b" the needle is here ")
    digest = hashlib.sha256()
    with open(tmp_path / "large.bin", "rb") as data:
        while block := data.read(1 << 24):
            digest.update(block)
    row = FC.scan_digests(spark, str(tmp_path)).first()
    assert (row.length, row.hash, row.plain) == (size, digest.hexdigest(), False)
    chunks = FC.scan_chunks(spark, str(tmp_path))
    assert chunks.rdd.getNumPartitions() == 17
    core = F.substring("content", F.col("lead") + 1, (F.col("stop") - F.col("start")).cast("int"))
    got = chunks.agg(F.count_if(F.contains(core, F.lit(b"needle"))).alias("hits"), F.sum(F.col("stop") - F.col("start")).alias("n"),
                     F.max(F.octet_length("content")).alias("most")).first()
    assert got.hits == 1 and got.n == size and got.most <= FC.CHUNK + 2 * FC.OVERLAP


def test_no_files_and_one_file(spark, tmp_path):
    assert FC.scan_chunks(spark, str(tmp_path)).count() == FC.scan_digests(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.txt").write_bytes(b"one file")
    (tmp_path / "b.log").write_bytes(b"another")
    assert FC.scan_chunks(spark, f"file://{tmp_path}/a.txt").first().content == b"one file"
    assert [r.length for r in FC.scan_digests(spark, str(tmp_path), "*.log").collect()] == [7]
