"""Secret scans over an incremental blob ledger.

Every historical version of a file is addressed by the hash of its content. A blob is scanned only if the ledger does not
hold it for the present version of the rules, once however many paths share it; findings are then joined back to all
paths. What is read twice is (path, hash), never the text of a copy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sieveline.llm.batches import portions
from sieveline.llm.storage import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more. ``hint`` has to occur, in lower case.

    ``sweep`` names a function of ``SWEEPS`` that gives the pattern's matches in time linear in the text, where the pattern
    itself would start over at each place that looks like a beginning.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""
    sweep: str = ""


#: Kinds in the order in which spans with one start are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "akia"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULES = BASE + (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", 0, 0, "private key-----", "pem"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "eyj", "jwt"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{20,})", 1, 20, "bearer"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]{4,128})@", 1, 4, "://"),
)
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def rule_version(rules: Iterable[Rule] = RULES) -> str:
    """Changes whenever a rule does."""
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


_BEGIN, _END = (re.compile(rf"(?=(-----{word} [A-Z ]*PRIVATE KEY-----))") for word in ("BEGIN", "END"))
#: Runs are taken whole: with a dot asked for, one without any would be read again from each of its characters.
_TOKENS, _JWT = re.compile(r"[A-Za-z0-9_.-]+"), re.compile(r"\beyJ", re.ASCII)


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """From each BEGIN line to the next END line behind it; what a key contains begins no other."""
    ends = [(m.start(), m.end(1)) for m in _END.finditer(text)]
    done = at = 0
    for m in _BEGIN.finditer(text):
        if m.start() >= done:
            while at < len(ends) and ends[at][0] < m.end(1):
                at += 1
            if at == len(ends):
                return
            done = ends[at][1]
            yield m.start(), done


def jwt_spans(text: str) -> Iterator[tuple[int, int]]:
    """Three parts of a dotted run: the first from ``eyJ`` on with 8 characters behind it, the others 8 long. Parts between dots may be empty."""
    for m in _TOKENS.finditer(text):
        parts, at = m[0].split("."), m.start()
        places = []
        for p in parts:
            places.append((at, at + len(p)))
            at += len(p) + 1
        i = 0
        while i + 2 < len(parts):
            found = _JWT.search(text, places[i][0], places[i][1]) if len(parts[i + 1]) >= 8 and len(parts[i + 2]) >= 8 else None
            if found and places[i][1] - found.end() >= 8:
                yield found.start(), places[i + 2][1]
                i += 2
            i += 1


SWEEPS = {"pem": pem_spans, "jwt": jwt_spans}


def scanner(rules: Iterable[Rule]):
    """``text -> [(kind, start, end)]``, by start and then in the order of the rules. Places are code points."""
    compiled = [(i, r, re.compile(r.pattern, re.ASCII)) for i, r in enumerate(rules)]

    def scan(text: str) -> list[dict]:
        lower = text.lower() if any(r.hint for _, r, _ in compiled) else ""
        found = []
        for i, r, p in compiled:
            if not r.hint or r.hint in lower:
                if r.sweep:
                    found += [(a, i, b, r.kind) for a, b in SWEEPS[r.sweep](text)]
                else:
                    found += [(m.start(), i, m.end(), r.kind) for m in p.finditer(text) if len(m.group(r.group)) >= r.least]
        return [{"kind": kind, "start": a, "end": b} for a, _, b, kind in sorted(found)]

    return scan


def addressed(versions: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``blob``, the SHA-256 of the content. A null text is the empty blob."""
    return versions.select(*keys, F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("blob"))


def scan_blobs(blobs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """``blob, spans`` for a table ``blob, text`` with one row per blob."""
    rules = tuple(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in portions(batches):
            spans = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], ["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, f"blob binary, spans {SPANS}")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None,
                  rules: Iterable[Rule] = RULES, text_col: str = "text",
                  keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Findings of all paths, and the ledger's new entries.

    ``versions``: a row per path and version, named by ``keys``; other columns are not read. ``ledger``: ``blob,
    rule_version`` of earlier scans, and ``findings`` what they found (``blob, rule_version, spans``), needed with a ledger. Returned are
    ``keys, blob, spans`` for every row of ``versions`` (no finding: an empty array) and ``blob, rule_version, spans`` of
    the blobs scanned now, to be appended to both. Repeated rows are scanned once and come back as often as they are
    given; null keys are keys like any other; an empty table gives two empty tables.
    """
    if ledger is not None and findings is None:
        raise ValueError("a ledger needs the findings of its scans: blobs in it aren't scanned again")
    rules = tuple(rules)
    version = rule_version(rules)
    paths = written(addressed(versions, text_col, keys), "blobs")
    fresh = paths.groupBy("blob").agg(F.min(F.struct(*keys)).alias("at"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version).select("blob").distinct()
        fresh = fresh.join(known, "blob", "left_anti")
    # One path stands for each unseen blob; only texts at those paths are read on.
    at = fresh.select(*[F.col(f"at.{k}").alias(f"_{i}") for i, k in enumerate(keys)], F.col("blob").alias("_blob"))
    texts = versions.select(*keys, F.coalesce(text_col, F.lit("")).alias("text"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & texts[k].eqNullSafe(at[f"_{i}"])
    picked = texts.join(at, same).where(F.unhex(F.sha2("text", 256)) == F.col("_blob")).select(F.col("_blob").alias("blob"), "text")
    scanned = written(scan_blobs(picked, rules).dropDuplicates(["blob"]), "findings")
    everything = scanned
    if findings is not None:
        everything = scanned.unionByName(findings.where(F.col("rule_version") == version).select("blob", "spans"))
    hits = everything.where(F.size("spans") > 0)
    out = paths.join(hits, "blob", "left").select(*keys, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return out, scanned.select("blob", F.lit(version).alias("rule_version"), "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: Iterable[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def mask_secrets(docs: DataFrame, key: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mark``; overlapping spans are one. Rows without findings stay as they are."""
    spans, _ = scan_versions(docs, text_col=text_col, keys=(key,))
    hits = spans.where(F.size("spans") > 0).groupBy(F.col(key).alias("_key"), "blob").agg(F.any_value("spans").alias("_spans"))
    blob = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    joined = docs.join(hits, docs[key].eqNullSafe(hits["_key"]) & (blob == hits["blob"]), "left")
    found = hits["_spans"].isNotNull()
    clean = F.when(found, _masked(F.when(found, docs[text_col]), F.when(found, hits["_spans"]), F.lit(mark))).otherwise(docs[text_col])
    return joined.select(*[clean.alias(c) if c == text_col else docs[c] for c in docs.columns])


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, spans: pd.Series, marks: pd.Series) -> pd.Series:
    """Texts with their spans replaced, the pieces joined once; a span that begins inside the one before only prolongs it."""
    out = []
    for text, each, mark in zip(texts, spans, marks, strict=True):
        if text is None or each is None:
            out.append(None)
            continue
        pieces, at = [], 0
        for s in each:
            if s["start"] >= at:
                pieces += [text[at:s["start"]], mark]
            at = max(at, s["end"])
        out.append("".join([*pieces, text[at:]]))
    return pd.Series(out, dtype=object)
