import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.operators import files as FI
from sieveline.operators import scoring
from sieveline.operators.lines import mask_by_verdicts
from sieveline.operators.rules import as_rules
from sieveline.sources import readers, sinks
from sieveline.streaming import jobs


def _docx(*paragraphs, name="word/document.xml"):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if name.startswith("word"):
            z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(name, f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    files = {"a.docx": _docx("hello", "secret AKIA here"), "b.hwpx": _docx("한글 문서", name="Contents/section0.xml"), "c.txt": b"plain AKIA", "d.png": b"\x89PNG\r\n\x1a\n0000", "e.pdf": b"%PDF-1.4 x", "f.docx": _docx("x" * 10), "g.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"0" * 300}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_scan_files(spark, folder):
    found = readers.scan_attachments(spark, folder).withColumn("message_id", F.when(F.col("path").endswith("b.hwpx"), "m2").otherwise("m1"))
    rules = as_rules([("aws", "AKIA", "masking", 0, None), ("any", "hello", "block", 0, None)])
    verdicts = FI.scan_files(found, rules, max_size=5000)
    got = {r.path.rsplit("/", 1)[1]: r for r in verdicts.collect()}
    assert (got["a.docx"].action, got["a.docx"].policy_name, got["a.docx"].file_info.chunk) == ("masking", "aws", "hello\nsecret AKIA here")
    assert (got["b.hwpx"].action, got["b.hwpx"].file_info.mime_type, got["b.hwpx"].file_info.chunk) == ("", "application/zip", "한글 문서")
    assert got["c.txt"].action == "block" and got["c.txt"].policy_name.startswith(C.REASON_EXTENSION)
    assert got["d.png"].file_info.mime_type == "image/png" and got["d.png"].action == "block"
    assert got["e.pdf"].error == got["e.pdf"].policy_name == "unsupported file type application/pdf" and got["e.pdf"].action == "block"
    assert len(got["f.docx"].file_info.hash) == 64
    bundle = {r.message_id: (r.action, r.n_files, r.n_blocked) for r in FI.bundle_file_decision(verdicts).collect()}
    assert bundle == {"m1": ("block", 6, 4), "m2": ("allow", 1, 0)}


def test_types_are_told_by_the_whole_content(spark):
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as z:
        z.writestr("padding.bin", b"0" * 6000)
        z.writestr("word/document.xml", "<a/>")
    rows = [("late", big.getvalue()), ("tail", b"a" * 70 + b"\xff\xfe"), ("nul", b"ab\0cd"), ("late_nul", b"a" * 5000 + b"\0"), ("text", ("é" * 3000).encode()), ("p0p0", b"p0p0p0"), ("empty", b"")]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k string, c binary").select("k", FI.sniff_mime(F.col("c")).alias("m")).collect()}
    other = "application/octet-stream"
    assert got == {"late": FI.DOCX_MIME, "tail": other, "nul": other, "late_nul": other, "text": "text/plain", "p0p0": "text/plain", "empty": "text/plain"}


def test_unreadable_files_are_blocked(spark):
    files = spark.createDataFrame([("m", "/a.docx", b"PK\x03\x04broken word/"), ("m", "/b.pdf", b"%PDF-1.4")], "message_id string, path string, content binary").withColumn("length", F.octet_length("content").cast("bigint"))
    verdicts = FI.scan_files(files, as_rules([("x", "zzz", "masking", 0, None)]))
    assert {(r.action, r.error is not None) for r in verdicts.collect()} == {("block", True)}
    assert FI.bundle_file_decision(verdicts).first().n_blocked == 2


def test_plain_text_and_bad_prompts(spark):
    from sieveline.functions import text as X

    files = spark.createDataFrame([("a", "text/plain", b"ok"), ("b", "text/plain", b"a\xffb"), ("c", "text/plain", None), ("d", None, b"x")], "path string, mime_type string, content binary")
    got = {r.path: (r.text, r.error) for r in FI.extract_file_text(files).collect()}
    assert got == {"a": ("ok", None), "b": ("a\ufffdb", None), "c": (None, None), "d": (None, "unsupported file type None")}
    prompts = spark.createDataFrame([("aGk=", True), ("***", True), ("/w==", True), ("***", False), (None, True)], "p string, e boolean")
    assert [r[0] for r in prompts.select(X.decode_prompt(F.col("p"), F.col("e"))).collect()] == ["hi", None, None, "***", None]


def test_utc_whatever_the_session(spark):
    from sieveline.functions import text as X

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        assert spark.range(1).select(X.iso_utc(F.timestamp_seconds(F.lit(0)))).first()[0] == "1970-01-01T00:00:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_size_limit_and_custom_extractor(spark, folder):
    found = readers.scan_attachments(spark, folder, glob="*.pdf").withColumn("message_id", F.lit("m"))
    small = FI.scan_files(found, as_rules([("x", "PDF", "block", 0, None)]), max_size=3).first()
    assert small.policy_name == f"{C.REASON_SIZE} (3)"
    custom = {"application/pdf": lambda b: b.decode()}
    assert FI.scan_files(found, as_rules([("x", "PDF", "block", 0, None)]), extractors=custom).first().policy_name == "x"
    plan = readers.scan_attachments(spark, folder, max_size=100)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(length,100)" in plan


def test_scan_prompts_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"prompt": "hi", "message_id": "1"}) + "\n" + json.dumps({"prompt": "YQ==", "encoding": True, "ai_service": 3, "attachments": [{"id": "f", "size": 3}]}))
    rows = readers.scan_prompts(spark, str(tmp_path / "p.json")).orderBy("prompt").collect()
    assert rows[1].filter_list == list(C.DEFAULT_FILTERS) and rows[1].encoding is False and rows[1].ai_service == 0 and rows[1].email == "" and rows[1].attachments == []
    assert rows[0].encoding and rows[0].ai_service == 3 and rows[0].attachments[0].id == "f"
    assert readers.scan_outputs(spark, str(tmp_path / "p.json")).columns[0] == "llm_output"


def test_audit_jsonl(spark, tmp_path):
    docs = spark.range(25).select(F.when(F.col("id") % 2 == 0, "input_filter").otherwise("regex_filter").alias("index"), F.lit("2024-01-01").alias("date"), F.struct("id").alias("doc"))
    sinks.sink_audit_jsonl(docs, str(tmp_path / "log"))
    lines = [json.loads(x) for f in (tmp_path / "log" / "index=input_filter" / "date=2024-01-01").glob("part*") for x in f.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == list(range(0, 25, 2))


def test_idempotent_create_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, n int")
    sinks.sink_idempotent_create(rows, path, "k", "n")
    sinks.sink_idempotent_create(rows, path, "k", "n")
    got = sorted((r.k or "", r.n) for r in spark.read.parquet(path).collect())
    assert got == [("", 4), ("", 4), ("a", 1), ("b", 3)]
    sinks.sink_upsert_latest(spark.createDataFrame([("a", 9), ("c", 5), ("c", 6)], "k string, n int"), path, str(tmp_path / "u"), "k", "n")
    assert sorted((r.k or "", r.n) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [("", 4), ("a", 9), ("b", 3), ("c", 6)]


def test_log_batches(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"index": "input_filter", "log_list": [{"a": 1}, {"b": [2]}]}) + "\n" + json.dumps({"index": "odd", "log_list": [5]}))
    got = readers.ingest_log_batch(readers.scan_log_batches(spark, str(tmp_path / "b.json")))
    assert sorted((r["index"], r.known, r.log.toJson()) for r in got.collect()) == [("input_filter", True, '{"a":1}'), ("input_filter", True, '{"b":[2]}'), ("odd", False, "5")]


def test_line_masking(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nc"), (2, "x")], "id int, text string")
    verdicts = spark.createDataFrame([(1, 1, "risky"), (1, 1, "risky"), (1, 4, "risky"), (1, 2, "safe"), (1, 99, "risky")], "id int, line int, risk string")
    got = {r.id: r.masked_text for r in mask_by_verdicts(df, "id", "text", verdicts).collect()}
    assert got == {1: "[MASKED]\nb\n\n[MASKED]", 2: "x"}


def test_scoring_isolates_failures(spark):
    def make():
        def score(texts: pd.Series):
            if any("slow" in t for t in texts):
                raise TimeoutError
            if any("bad" in t for t in texts):
                raise ValueError
            return ["" if t == "mute" else t.upper() for t in texts]

        return score

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "slow"), (4, "mute")], "id int, text string").coalesce(1)
    got = {r.id: (r.response, r.status) for r in scoring.score_text(df, ["id"], "text", make).collect()}
    assert got == {1: ("OK", None), 2: (None, "error"), 3: (None, "timeout"), 4: ("" if got[4][0] == "" else None, "empty_response")}
    blocked = spark.createDataFrame([(1,), (1,)], "id int")
    assert scoring.pending(df, blocked, "id").count() == 3


def test_batches_are_cut_by_padded_size(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def score(texts: pd.Series):
            sizes = [len(t or "") for t in texts]
            if len(texts) > 8 or (len(texts) > 1 and max(sizes) * len(texts) > 400):
                seen.add(1)
            if None in list(texts):
                raise ValueError
            return [str(len(t)) for t in texts]

        return score

    rows = [(i, "x" * (i * 37 % 211 + 1)) for i in range(500)] + [(500, "y" * 5000), (501, None), (502, "")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    got = scoring.score_text(df, ["id"], "text", make, batch_chars=400, batch_texts=8, report=True).collect()
    assert seen.value == 0 and {r.id: r.response for r in got} == {i: None if t is None else str(len(t)) for i, t in rows}
    assert [r.id for r in got if r.status] == [501]
    padded, real = sum(r.batch_longest for r in got), sum(len(t or "") for _, t in rows)
    assert real <= padded < 1.1 * real
    assert scoring.score_text(df.limit(0), ["id", "text"], "text", make).columns == ["id", "text", "response", "status"]


def test_a_scorer_that_forgets_answers_fails_text_by_text(spark):
    df = spark.createDataFrame([(i, "a" * i) for i in range(1, 6)], "id int, text string").coalesce(1)
    got = scoring.score_text(df, ["id"], "text", lambda: lambda texts: [t for t in texts if len(t) != 3]).collect()
    assert {r.id: r.status for r in got} == {1: None, 2: None, 3: "error", 4: None, 5: None}


# --- streams ---------------------------------------------------------------------------------------------------------


def _put(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(path)


def test_account_stream_appends_each_account_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    ddl = "email string, ai_service int"
    for rows in ([("a", 1), ("a", 1), ("b", 2)], [("b", 2), ("c", 3)]):
        _put(spark, src, rows, ddl)
        jobs.stream_account_dedup(jobs.read_files(spark, src, spark.createDataFrame([], ddl).schema), out, ck, every=None).awaitTermination()
    assert sorted(r.user_key for r in spark.read.parquet(out).collect()) == ["a_1", "b_2", "c_3"]


def test_policy_refresh_sees_the_new_policy(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    ddl = "filter_id string, scope string, id string, action string, rule string"
    seen = []
    state = {"rules": [("f", "default", "1", "block", "a")]}

    def policy():
        return spark.createDataFrame(state["rules"], ddl)

    def apply(batch, rules):
        state["rules"] = [("f", "default", "1", "allow", "a")]
        return batch.crossJoin(rules.select("action"))

    _put(spark, src, [(1,)], "n int")
    _put(spark, src, [(2,)], "n int")
    stream = jobs.read_files(spark, src, spark.createDataFrame([], "n int").schema, files_per_trigger=1)
    jobs.stream_policy_refresh(stream, policy, apply, out, ck, every=None, on_change=lambda d: seen.append(d.collect())).awaitTermination()
    assert sorted(r.action for r in spark.read.parquet(out).collect()) == ["allow", "block"]
    assert len(seen) == 1 and seen[0][0].change == "modified"


def test_policy_refresh_goes_on_after_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    ddl, seen = "filter_id string, scope string, id string, action string, rule string", []
    stream = lambda: jobs.read_files(spark, src, spark.createDataFrame([], "n int").schema)
    for n, action in enumerate(("block", "allow", "allow", "masking")):
        _put(spark, src, [(n,)], "n int")
        jobs.stream_policy_refresh(stream(), lambda a=action: spark.createDataFrame([("f", "default", "1", a, "x")], ddl), lambda b, r: b.crossJoin(r.select("action")),
                                   out, ck, every=None, on_change=lambda d: seen.append(d.first().change)).awaitTermination()
    assert sorted((r.n, r.action) for r in spark.read.parquet(out).collect()) == [(0, "block"), (1, "allow"), (2, "allow"), (3, "masking")]
    assert seen == ["modified", "modified"]
    # A batch that is processed again meets the policy it met before.
    notes = {r.batch: r["at"] for r in spark.read.parquet(f"{ck}/policy_of_batch").collect()}
    assert len(notes) == 4 and notes[1] == notes[2] != notes[3]


def test_idempotent_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for rows in ([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:00:01"), ("b", "2024-01-01 10:00:02")], [("a", "2024-01-01 21:00:00"), ("c", "2024-01-01 21:00:00"), (None, "2024-01-01 21:00:00")]):
        _put(spark, src, rows, "k string, ts string")
        stream = jobs.read_files(spark, src, spark.createDataFrame([], "k string, ts timestamp").schema)
        jobs.stream_idempotent(stream, "k", out, ck, order="ts").awaitTermination()
    assert sorted((r.k or "", r.ts.hour) for r in spark.read.parquet(out).collect()) == [("", 21), ("a", 10), ("b", 10), ("c", 21)]


def test_only_an_absent_table_counts_as_empty(spark, tmp_path):
    assert sinks.stored_table(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)footer|parquet"):
        sinks.stored_table(spark, str(tmp_path / "bad"))


def test_whole_rows_and_ties(spark):
    from sieveline.operators import accounts as A

    new = spark.createDataFrame([("k", "a1", "b9", 1), ("k", "a9", "b1", 2)], "id string, a string, b string, n int")
    target = spark.createDataFrame([("k", "x", "y"), ("o", "x", "y")], "id string, a string, b string")
    assert sorted(tuple(r) for r in A.upsert(target, new, "id", "n").collect()) == [("k", "a9", "b1"), ("o", "x", "y")]
    tied = {tuple(A.latest_by_key(target, spark.createDataFrame([("k", "n", "x"), ("k", "m", "x")], target.schema).repartition(p), "id", "b").where("id = 'k'").first()) for p in (1, 2, 5)}
    assert len(tied) == 1
    old_and_new = A.latest_by_key(target.where("id = 'k'"), spark.createDataFrame([("k", "new", "y")], target.schema), "id", "b")
    assert old_and_new.first().a == "new"
    assert len({sinks.create_only(new.repartition(p), None, "id").first().a for p in (1, 2)}) == 1
