"""What a model or scanner answered, turned into verdict columns."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import catalog as C
from sieveline.functions import text as X
from sieveline.functions.expr import let

# --- class probabilities ---------------------------------------------------------------------------------------------


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def attack_label(probs: Column) -> Column:
    """``struct<safe,label,reason,confidence>`` of the most probable class; no probabilities means an error, unsafe."""
    confidence = F.array_max(probs)
    cls = F.array_position(probs, confidence) - 1
    reason = (F.when(cls == 0, F.lit(None)).when(cls == 1, "jailbreak").when(cls == 2, "injection")
              .otherwise(F.concat(F.lit("unsafe_class_"), cls.cast("string"))))
    missing = probs.isNull() | (F.size(probs) <= 0)
    return F.struct(
        F.when(missing, False).otherwise(cls == 0).alias("safe"),
        F.when(missing, "ERROR").when(cls == 0, "SAFE").otherwise("UNSAFE").alias("label"),
        F.when(missing, "model_not_loaded").otherwise(reason).alias("reason"),
        F.when(missing, 0.0).otherwise(confidence).alias("confidence"))


def attack_action(label: Column) -> Column:
    """``struct<action,should_block,label,reason,confidence>``; everything unsafe is blocked."""
    safe = label["safe"]
    return F.struct(
        F.when(safe, C.ALLOW).otherwise(C.BLOCK).alias("action"), (~safe).alias("should_block"),
        F.when(~safe, F.lower(label["label"])).alias("label"),
        F.when(~safe, F.coalesce(label["reason"], F.lit(""))).alias("reason"),
        F.when(~safe, label["confidence"]).alias("confidence"))


# --- safety model ----------------------------------------------------------------------------------------------------


def parse_safety_response(raw: Column) -> Column:
    """``struct<action,content>`` of a chat completion; an answer that says Unsafe blocks, no answer allows."""
    content = X.safe_get(F.try_parse_json(raw), "$.choices[0].message.content")
    unsafe = F.coalesce(F.contains(content, F.lit("Unsafe")), F.lit(False))
    return F.struct(F.when(unsafe, C.BLOCK).otherwise(C.ALLOW).alias("action"), content.alias("content"))


def map_policy_action(action: Column, policy_name: Column, brand: str = "GUARD") -> Column:
    """``struct<action,action_code,masked_contents,block_message>`` of a policy's action; unknown actions allow."""
    block, mask = action == C.BLOCK, action == C.MASKING
    return F.struct(
        F.when(block, C.BLOCK).when(mask, C.MASKING).otherwise(C.ALLOW).alias("action"),
        F.when(block, C.CODE_BLOCK).when(mask, C.CODE_MASKING).otherwise(C.CODE_ALLOW).alias("action_code"),
        F.when(mask, X.mask_message(policy_name, brand)).otherwise("").alias("masked_contents"),
        F.when(block, X.block_message(policy_name, brand)).otherwise("").alias("block_message"))


# --- free-text verdicts ----------------------------------------------------------------------------------------------

FAILURES = ("timeout", "empty_response", "invalid_json_output")
FALLBACK_REASON = "llm_json_parse_recovered"
INVALID_DECISION = "invalid_decision_value"


def fail_closed(status: Column) -> Column:
    """``struct<decision,reasons>``: every failure blocks, with its own reason when it is a known one."""
    reason = F.when(status.isin(*FAILURES), status).otherwise(FALLBACK_REASON)
    return F.struct(F.lit(C.BLOCK).alias("decision"), F.array(reason).alias("reasons"))


def _without_fences(raw: Column) -> Column:
    """Fenced passages and ``json:`` labels go away; an answer that is all fence is left empty."""
    bare = F.regexp_replace(raw, r"(?s)```.*?```", "")
    bare = F.regexp_replace(bare, r"(?i)\bjson\s*:\s*", "")
    return F.trim(F.replace(bare, F.lit("﻿"), F.lit("")))


def _repaired(s: Column) -> Column:
    """Trailing commas removed, typographic quotes straightened."""
    return F.translate(F.regexp_replace(s, r",\s*([}\]])", "$1"), "“”’", "\"\"'")


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _object(s: Column) -> Column:
    """The text as one JSON object; the parser stops behind the first value, so text with more behind it is no object."""
    more = F.regexp_replace(s, _STRING, '""').rlike(r"\}\s*[^\s,\]}]")
    v = F.try_parse_json(s)
    return F.when(~more & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def _balanced_objects(s: str) -> list[str]:
    """Outermost ``{...}`` pieces, last first, ignoring braces inside double-quoted strings."""
    found, depth, start = [], 0, 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', s, re.S):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                found.append(s[start:m.end()])
    return found[::-1]


def salvage_object(s: str | None) -> str | None:
    """A JSON object out of prose, single-quoted or slightly broken text; None when there is none."""
    for piece in _balanced_objects(s or ""):
        for load in (json.loads, ast.literal_eval):
            try:
                value = load(piece)
            except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
                continue
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False, default=str)
    return None


@F.pandas_udf(T.StringType())
def _salvage(s: pd.Series) -> pd.Series:
    return s.map(salvage_object)


def recover_verdict_json(raw: Column) -> Column:
    """``struct<decision,reasons>`` of a model's free-text verdict.

    Clean and lightly broken JSON is parsed in the JVM. Only what both parses reject is handed, alone, to the Python
    salvage step. No answer or no verdict in it blocks.
    """
    # No lambda may enclose a Python function, so nothing is bound here; equal sub-expressions are shared by codegen.
    bare = _without_fences(raw)
    native = F.coalesce(_object(bare), _object(_repaired(bare)))
    rest = F.when(native.isNull() & (F.coalesce(bare, F.lit("")) != ""), _repaired(bare))
    verdict = F.coalesce(native, F.try_parse_json(_salvage(rest)))
    return (F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", fail_closed(F.lit("empty_response")))
            .otherwise(_verdict_of(verdict)))


def recover_verdicts(df: DataFrame, raw: Column, name: str = "verdict") -> DataFrame:
    """``df`` with the ``recover_verdict_json`` of an answer as a column: the same result, each step computed once.

    Parsing, salvage and reading of the fields are columns of their own, so what a step needs several times is bound.
    """
    steps = df.withColumn("__raw", raw).withColumn("__bare", _without_fences(F.col("__raw")))
    bare = F.col("__bare")
    steps = steps.withColumn("__native", F.coalesce(_object(bare), let(_repaired(bare), _object)))
    open_ = F.col("__native").isNull() & (F.coalesce(bare, F.lit("")) != "")
    steps = steps.withColumn("__saved", _salvage(F.when(open_, _repaired(bare))))
    found = let(F.coalesce("__native", F.try_parse_json("__saved")), _verdict_of)
    empty = F.trim(F.coalesce("__raw", F.lit(""))) == ""
    return steps.select(*df.columns, F.when(empty, fail_closed(F.lit("empty_response"))).otherwise(found).alias(name))


def _verdict_of(verdict: Column) -> Column:
    decision = F.lower(F.coalesce(X.safe_get(verdict, "$.decision"), F.lit("")))
    known = decision.isin(C.ALLOW, C.BLOCK)
    listed = F.try_variant_get(verdict, "$.reasons", "array<string>")
    single = F.when(F.schema_of_variant(F.try_variant_get(verdict, "$.reasons", "variant")) == "STRING",
                    F.array(X.safe_get(verdict, "$.reasons")))
    reasons = F.coalesce(listed, single, F.array().cast("array<string>"))
    reasons = F.when(known, reasons).otherwise(F.concat(reasons, F.array(F.lit(INVALID_DECISION))))
    parsed = F.struct(F.when(known, decision).otherwise(C.BLOCK).alias("decision"),
                      F.array_sort(F.array_distinct(reasons)).alias("reasons"))
    return F.when(verdict.isNull(), fail_closed(F.lit("invalid_json_output"))).otherwise(parsed)


LINE_VERDICTS = "array<struct<line:int,risk:string,original:string,reasons:array<string>,confidence:double>>"


def _all_lines(text: Column, reason: str, confidence: float) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(
        (i + 1).alias("line"), F.lit("risky").alias("risk"), line.alias("original"),
        F.array(F.lit(reason)).alias("reasons"), F.lit(confidence).alias("confidence"))).cast(LINE_VERDICTS)


def recover_line_verdicts(raw: Column, text: Column, status: Column | None = None) -> Column:
    """Line verdicts of a model's answer; without a readable one every line is risky.

    ``status`` may be ``timeout`` or ``error``; no answer at all counts as an error.
    """
    bare = _without_fences(raw)

    def listed(s: Column) -> Column:
        return let(F.try_parse_json(s), lambda v: F.when(
            F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", LINE_VERDICTS)))

    span = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    parsed = F.coalesce(listed(bare), listed(span), listed(_repaired(span)))
    status = F.lit(None).cast("string") if status is None else status
    return (F.when(status == "timeout", _all_lines(text, "llm_timeout", 0.0))
            .when(status.isNotNull() | (F.trim(F.coalesce(raw, F.lit(""))) == ""), _all_lines(text, "llm_error", 0.0))
            .when(parsed.isNull(), _all_lines(text, "json_parse_error", 0.5)).otherwise(parsed))


def line_verdict_summary(lines: Column) -> Column:
    """``struct<decision,reasons,risky_lines>``; one risky line blocks."""
    risky = F.filter(lines, lambda v: v["risk"] == "risky")
    return F.struct(
        F.when(F.size(risky) > 0, C.BLOCK).otherwise(C.ALLOW).alias("decision"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(risky, lambda v: F.coalesce(
            v["reasons"], F.array().cast("array<string>")))))).alias("reasons"),
        F.transform(risky, lambda v: v["line"]).alias("risky_lines"))


def reasons_to_types(reasons: Column) -> Column:
    """Personal-data types named by the reasons, sorted."""

    def named(*words: str) -> Column:
        return F.exists(reasons, lambda r: F.lower(r).rlike("|".join(words)))

    return F.array_compact(F.array(
        F.when(named("account", "card"), "account"), F.when(named("address"), "address"),
        F.when(named("email"), "email"), F.when(named("phone"), "phone")))


def distinct_reasons(reasons: Column) -> Column:
    return F.array_sort(F.array_distinct(reasons))


def truthy_decision(decision: Column, score: Column, spans: Column | None = None) -> Column:
    hit = X.unified_decision(decision).isin("BLOCK", "FLAG", "DETECT", "FOUND") | (F.coalesce(score, F.lit(0.0)) > 0)
    return hit if spans is None else hit | (F.size(spans) > 0)


def build_model_block_message(reasons: Column, ids: dict[str, Column] | None = None,
                              guide: str = C.MODEL_BLOCK_GUIDE) -> Column:
    """Guide, cause and, if asked for, ids, as paragraphs."""
    sorted_reasons = distinct_reasons(reasons)
    cause = F.when(F.size(sorted_reasons) > 0, F.array_join(sorted_reasons, ", ")).otherwise("unspecified")
    parts = [F.lit(guide), F.concat(F.lit(f"{C.MODEL_BLOCK_CAUSE}: "), cause)]
    if ids:
        shown = F.array_compact(F.array(*[
            F.when(X.blank_to_null(c).isNotNull(), F.concat(F.lit(f"{k}="), c)) for k, c in ids.items()]))
        parts.append(F.when(F.size(shown) > 0, F.concat(F.lit(f"{C.MODEL_BLOCK_IDS}: "), F.array_join(shown, ", "))))
    return F.concat_ws("\n\n", *parts)


# --- scanner results -------------------------------------------------------------------------------------------------

# Sections and field names a scanner may use
SCANNER_SECTIONS = ("spans", "matches", "findings", "entities", "detections", "results")
SCANNER_TYPE_FIELDS = ("type", "kind", "label")
SCANNER_VALUE_FIELDS = ("value", "text", "match")


def normalize_scanner_spans(raw: Column, text: Column) -> Column:
    """``array<struct<start,end,type,value>>`` of any known section; spans outside the text are dropped."""
    body = F.try_parse_json(raw)
    items = F.concat(*[F.coalesce(F.try_variant_get(body, f"$.{s}", "array<variant>"), F.array().cast("array<variant>"))
                       for s in SCANNER_SECTIONS])

    def first(v: Column, names: tuple[str, ...]) -> Column:
        return F.coalesce(*[X.blank_to_null(X.safe_get(v, f"$.{n}")) for n in names], F.lit(""))

    def one(v: Column) -> Column:
        start, end = X.safe_get(v, "$.start", "int"), X.safe_get(v, "$.end", "int")
        nested = start.isNull() | end.isNull()
        return F.struct(
            F.when(nested, X.safe_get(v, "$.span.start", "int")).otherwise(start).alias("start"),
            F.when(nested, X.safe_get(v, "$.span.end", "int")).otherwise(end).alias("end"),
            first(v, SCANNER_TYPE_FIELDS).alias("type"), first(v, SCANNER_VALUE_FIELDS).alias("value"))

    return F.filter(F.transform(items, one), lambda s: (
        (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))))
