"""Attachments: type, gate, text, rules, decision per message."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from re import _constants as K
from re import _parser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions.blocks import in_blocks
from sieveline.functions.expr import let
from sieveline.functions.text import hash_content, preview_chunk
from sieveline.operators.rules import Rule, first_matching_rule
from sieveline.sources.file_chunks import CHUNK, OVERLAP, SPLIT, scan_chunks, scan_digests

# Leading bytes (hex) of the file types the gate knows
SIGNATURES = (
    ("504B0304", "application/zip"), ("25504446", "application/pdf"), ("D0CF11E0A1B11AE1", "application/msword"),
    ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("1F8B", "application/gzip"),
    ("7F454C46", "application/x-executable"), ("4D5A", "application/x-dosexec"))
DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def mime_of(head: Column, office: Column, plain: Column) -> Column:
    """Type by leading bytes (at least 8, or all); ``office``: has a name of an Office part, ``plain``: UTF-8 without a NUL."""
    def by_signature(digits: Column) -> Column:
        test = F.when(digits.startswith("504B0304") & office, DOCX_MIME)
        for signature, mime in SIGNATURES:
            test = test.when(digits.startswith(signature), mime)
        return test.when(plain, "text/plain").otherwise("application/octet-stream")

    return let(F.hex(F.substring(head, F.lit(1), F.lit(8))), by_signature)


def sniff_mime(content: Column) -> Column:
    """Type from the leading bytes; a zip with Office parts is a docx, valid UTF-8 without a NUL anywhere is text."""
    # A zip names its entries in its central directory, at the end, whatever their number and sizes.
    office = [F.contains(content, F.lit(n).cast("binary")) for n in ("[Content_Types].xml", "word/")]
    is_text = ~F.contains(content, F.unhex(F.lit("00"))) & F.is_valid_utf8(content.cast("string"))
    return mime_of(content, office[0] | office[1], is_text)


def mime_to_ext(mime: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in C.MIME_EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, mime), F.lit(C.UNKNOWN_EXTENSION))


def file_gate(ext: Column, size: Column, allow_ext: Column | Sequence[str] = C.ALLOWED_EXTENSIONS,
              max_size: Column | int = C.MAX_FILE_SIZE) -> Column:
    """``struct<allowed,reason>``: the extension list first, then the size limit."""
    allow = allow_ext if isinstance(allow_ext, Column) else F.array(*[F.lit(e) for e in allow_ext])
    limit = max_size if isinstance(max_size, Column) else F.lit(max_size)
    reason = (F.when(~F.array_contains(allow, ext), F.concat(F.lit(f"{C.REASON_EXTENSION} ("), F.array_join(allow, ","), F.lit(")")))
              .when(size > limit, F.concat(F.lit(f"{C.REASON_SIZE} ("), limit.cast("string"), F.lit(")"))).otherwise(""))
    return F.struct((reason == "").alias("allowed"), reason.alias("reason"))


# --- text extraction -------------------------------------------------------------------------------------------------


def _plain(content: bytes) -> str:
    return content.decode("utf-8", errors="replace")


def _zip_xml(content: bytes) -> str:
    """Paragraph texts of the XML parts of a zipped document (docx, hwpx)."""
    paragraphs: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = [n for n in archive.namelist() if re.fullmatch(r"word/document\.xml|Contents/section\d+\.xml", n)]
        for name in sorted(parts):
            for _, node in ElementTree.iterparse(archive.open(name)):
                if node.tag.rsplit("}", 1)[-1] == "p":
                    texts = (t.text or "" for t in node.iter() if t.tag.rsplit("}", 1)[-1] == "t")
                    paragraphs.append("".join(texts))
                    node.clear()
    return "\n".join(paragraphs)


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "text/plain": _plain, DOCX_MIME: _zip_xml, "application/zip": _zip_xml, "application/octet-stream": _zip_xml}
READ = pa.struct([("text", pa.string()), ("error", pa.string())])


def extract_file_text(files: DataFrame, keep: Sequence[str] = ("path",),
                      extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``keep`` columns plus ``text, error`` of rows with ``mime_type, content``; an unreadable file gets an error.

    Rows whose content is null (rejected by the gate) pass through untouched, so nothing has to be joined back. ``files`` is
    evaluated once. What crosses to Python comes in batches cut by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``); a task
    holds one file and one block of texts as Python objects, whatever the batch holds.
    """
    table = {**EXTRACTORS, **(extractors or {})}

    def read(mime: str | None, content: bytes | None) -> tuple[str | None, str | None]:
        if content is None:
            return None, None
        reader = table.get(mime)
        if reader is None:
            return None, f"unsupported file type {mime}"
        try:
            return reader(content), None
        except Exception as err:  # noqa: BLE001 - reported per file
            return None, str(err) or type(err).__name__

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return in_blocks(batches, read, READ, lambda done: len(done[0] or ""))

    # Said to be non-deterministic, it is evaluated once per file: a filter on its result would evaluate it again.
    reading = F.arrow_udf(run, "text string, error string").asNondeterministic()
    # Plain text needs no Python: it is decoded in the JVM, unless the caller brings a reader of its own for it.
    in_jvm = F.lit("text/plain" not in (extractors or {})) & F.coalesce(F.col("mime_type") == "text/plain", F.lit(False))
    plain = F.when(in_jvm, F.make_valid_utf8(F.col("content").cast("string")))
    parted = files.select(*keep, F.col("mime_type").alias("__mime"), plain.alias("__plain"), F.when(~in_jvm, F.col("content")).alias("__content"))
    done = parted.select(*keep, "__plain", reading("__mime", "__content").alias("__read"))
    return done.select(*keep, F.coalesce("__plain", "__read.text").alias("text"), F.col("__read.error").alias("error"))


# --- decisions -------------------------------------------------------------------------------------------------------


def scan_file_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """First rule that occurs as ``struct<action,policy_id,policy_name>``; empty strings when none does."""
    def told(hit: Column) -> Column:
        return F.struct(F.coalesce(hit["action"], F.lit("")).alias("action"), F.coalesce(hit["rule_id"], F.lit("")).alias("policy_id"),
                        F.coalesce(hit["name"], F.lit("")).alias("policy_name"))

    return let(first_matching_rule(text, rules), told)


def _verdict() -> list[Column]:
    """Action, policy id and policy name from ``allowed, reason, error, __hit``.

    A file that could not be read was not looked at: it is blocked, with its error as the reason.
    """
    def unless_blocked(value: Column, blocked: Column, failed: Column) -> Column:
        return F.when(~F.col("allowed"), blocked).when(F.col("error").isNotNull(), failed).otherwise(value)

    return [unless_blocked(F.col("__hit.action"), F.lit(C.BLOCK), F.lit(C.BLOCK)).alias("action"),
            unless_blocked(F.col("__hit.policy_id"), F.lit(""), F.lit("")).alias("policy_id"),
            unless_blocked(F.col("__hit.policy_name"), F.col("reason"), F.col("error")).alias("policy_name")]


def scan_files(files: DataFrame, rules: Sequence[Rule], allow_ext=C.ALLOWED_EXTENSIONS, max_size=C.MAX_FILE_SIZE,
               extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """File verdicts of ``(message_id, path, length, content)``: gate, then text, then the first matching rule."""
    typed = files.withColumn("mime_type", sniff_mime(F.col("content")))
    typed = typed.withColumn("file_ext", mime_to_ext(F.col("mime_type"))).withColumn("hash", hash_content(F.col("content")))
    gated = typed.withColumn("__gate", file_gate(F.col("file_ext"), F.col("length"), allow_ext, max_size))
    gated = (gated.withColumn("allowed", F.col("__gate.allowed")).withColumn("reason", F.col("__gate.reason")).drop("__gate")
             .withColumn("content", F.when(F.col("allowed"), F.col("content"))))
    keep = ["message_id", "path", "length", "mime_type", "file_ext", "hash", "allowed", "reason"]
    read = extract_file_text(gated, keep, extractors).withColumn("__hit", scan_file_rules(F.col("text"), rules))

    return read.select(
        "message_id", "path", *_verdict(),
        F.struct("mime_type", "file_ext", F.col("length").alias("size"), "hash",
                 preview_chunk(F.col("text")).alias("chunk")).alias("file_info"), "error")


def _looks_around(items) -> bool:
    """The pattern tests for the start or end of a text or line, or looks around."""
    for op, arg in items:
        if op in (K.ASSERT, K.ASSERT_NOT) or (op is K.AT and arg not in (K.AT_BOUNDARY, K.AT_NON_BOUNDARY)):
            return True
        for inner in arg if isinstance(arg, tuple | list) else (arg,):
            branches = inner if isinstance(inner, list) else [inner]
            if any(isinstance(branch, _parser.SubPattern) and _looks_around(branch) for branch in branches):
                return True
    return False


def scan_large_files(spark: SparkSession, path: str, rules: Sequence[Rule], glob: str | None = None, *, allow_ext=C.ALLOWED_EXTENSIONS,
                     max_size=C.MAX_FILE_SIZE, chunk: int = CHUNK, overlap: int = OVERLAP, split: int = SPLIT) -> DataFrame:
    """Verdicts as of ``scan_files`` for files of any size, whose contents are never in one cell.

    Digest and type come from one reading of each file; the text of admitted plain files is scanned in chunks, and the first
    rule that occurs in any chunk is the file's. A hit is found if it is no longer than half of ``overlap`` bytes. Rules that
    test for the start or end of text or line, or look around, depend on more than that and are refused; word boundaries are kept, as
    chunks end at white space (of which half of ``overlap`` must hold some). Files of other types get an error: their readers need the
    whole file. No file gives no rows.
    """
    refused = [r.name for r in rules if _looks_around(_parser.parse(r.rule, r.flags))]
    if refused:
        raise ValueError(f"rules that need the whole text: {', '.join(refused)}")
    typed = scan_digests(spark, path, glob, chunk=chunk, split=split).withColumn("mime_type", mime_of(F.col("head"), F.col("office"), F.col("plain")))
    typed = typed.withColumn("file_ext", mime_to_ext(F.col("mime_type")))
    gated = typed.withColumn("__gate", file_gate(F.col("file_ext"), F.col("length"), allow_ext, max_size)).select("*", "__gate.*").drop("__gate")
    def text(content: str) -> Column:
        return F.make_valid_utf8(F.col(content).cast("string"))

    hits = scan_chunks(spark, path, glob, chunk=chunk, overlap=overlap, split=split).select(
        "path", first_matching_rule(text("content"), rules).alias("__rule"))
    # One small row for each file with a hit and task goes on.
    found = hits.where(F.col("__rule").isNotNull()).groupBy("path").agg(F.min("__rule").alias("__rule"))
    error = F.when(F.col("allowed") & (F.col("mime_type") != "text/plain"), F.concat(F.lit("unsupported file type "), "mime_type"))
    empty = F.lit("")
    told = F.struct(*[F.coalesce(F.col(f"__rule.{c}"), empty).alias(n) for c, n in (("action", "action"), ("rule_id", "policy_id"), ("name", "policy_name"))])
    read = gated.join(found, "path", "left").withColumn("error", error).withColumn("__hit", told)
    shown = F.when(F.col("allowed") & F.col("error").isNull(), preview_chunk(text("head")))
    return read.select("path", *_verdict(), F.struct("mime_type", "file_ext", F.col("length").alias("size"), "hash", shown.alias("chunk")).alias("file_info"), "error")


def bundle_file_decision(verdicts: DataFrame) -> DataFrame:
    """One row per message: blocked if any file is, with the number of files by outcome.

    Counts, not a list of files: they aggregate partially, so a message id shared by very many rows stays cheap. The
    per-file summary is the verdict table itself.
    """
    block = F.col("action") == C.BLOCK
    return verdicts.groupBy("message_id").agg(
        F.when(F.bool_or(block), C.BLOCK).otherwise(C.ALLOW).alias("action"), F.count(F.lit(1)).alias("n_files"),
        F.count_if(block).alias("n_blocked"))
