"""Code blocks in a text and the risk of what they call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions.expr import let
from sieveline.functions.regex import java_pattern

BLOCKS = "array<struct<lang:string,code:string>>"
_FENCE = "```"


def extract_code_blocks(text: Column, *, strict: bool = False) -> Column:
    """Fenced blocks as ``array<struct<lang,code>>``.

    Strict mode lower-cases the language, allows more language names and drops empty blocks.
    """
    java = java_pattern(C.FENCED_CODE_STRICT if strict else C.FENCED_CODE)
    langs = F.regexp_extract_all(text, F.lit(java), F.lit(1))
    codes = F.regexp_extract_all(text, F.lit(java), F.lit(2))

    def block(lang: Column, code: Column) -> Column:
        named = F.lower(F.trim(lang)) if strict else F.coalesce(
            F.when(lang != "", lang), F.lit(C.CODE_DEFAULT_LANGUAGE))
        return F.struct(named.alias("lang"), F.regexp_replace(code, r"(?U)^\s+|\s+$", "").alias("code"))

    blocks = F.zip_with(langs, codes, block)
    if strict:
        blocks = F.filter(blocks, lambda b: b["code"] != "")
    return F.when(F.contains(text, F.lit(_FENCE)), blocks).otherwise(F.array().cast(BLOCKS)).cast(BLOCKS)


def risk_of(code: Column) -> Column:
    """Share of the risky call patterns that occur in the code."""
    hits = [F.when(code.rlike(p), 1).otherwise(0) for p in C.RISKY_CODE]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.least(total / F.lit(float(len(C.RISKY_CODE))), F.lit(1.0))


def score_code_risk(blocks: Column, source: str = "user") -> Column:
    """``array<struct<source,lang,severity>>``."""
    return F.transform(blocks, lambda b: F.struct(
        F.lit(source).alias("source"), b["lang"].alias("lang"), risk_of(b["code"]).alias("severity")))


def worst_score(findings: Column, threshold: float = 0.5) -> Column:
    """``struct<worst,n,has_issue>`` over scored findings."""
    return let(findings, lambda fs: F.struct(
        F.coalesce(F.array_max(F.transform(fs, lambda f: f["severity"])), F.lit(0.0)).alias("worst"), F.size(fs).alias("n"),
        F.exists(fs, lambda f: f["severity"] >= threshold).alias("has_issue")))


def decide_code_risk(text: Column, source: str = "user", threshold: float = 0.5, block: bool = True) -> Column:
    """``struct<detected,match_count,worst_score,final_action,findings>``; a text without fences is one block."""
    whole = F.array(F.struct(F.lit(C.CODE_DEFAULT_LANGUAGE).alias("lang"), text.alias("code"))).cast(BLOCKS)
    blocks = let(extract_code_blocks(text), lambda fenced: F.when(F.size(fenced) > 0, fenced).otherwise(whole))

    def verdict(findings: Column, summary: Column) -> Column:
        action = F.when(summary["has_issue"], "BLOCK" if block else "WARN").otherwise("ALLOW")
        return F.struct(
            summary["has_issue"].alias("detected"), summary["n"].alias("match_count"),
            summary["worst"].alias("worst_score"), action.alias("final_action"), findings.alias("findings"))

    judged = let(score_code_risk(blocks, source), lambda fs: let(worst_score(fs, threshold), lambda w: verdict(fs, w)))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", judged)


def code_scan_report(findings: Column, title: str = "code scan") -> Column:
    """Markdown table over ``array<struct<lang,decision,score,reason>>``."""

    def line(f: Column, i: Column) -> Column:
        return F.concat(
            F.lit("| "), (i + 1).cast("string"), F.lit(" | `"), F.coalesce(f["lang"], F.lit("unknown")), F.lit("` | `"),
            F.coalesce(f["decision"], F.lit("None")), F.lit("` | "), F.format_number(f["score"], 2), F.lit(" | "),
            F.coalesce(f["reason"], F.lit("")), F.lit(" |"))

    head = f"<details>\n<summary>{title}</summary>\n\n\n{C.REPORT_COLUMNS}\n{C.REPORT_RULE}\n"
    return F.when(F.size(findings) == 0, C.REPORT_EMPTY).otherwise(
        F.concat(F.lit(head), F.array_join(F.transform(findings, line), "\n"), F.lit("\n\n</details>")))


def report_verdict(findings: Column, block_on_findings: bool = False, min_severity: float = 0.5) -> Column:
    """``struct<has_issue,worst,blocked>`` of a report; blocked needs an issue and the worst score at the limit."""
    worst = F.coalesce(F.array_max(F.transform(findings, lambda f: f["score"])), F.lit(0.0))
    issue = F.exists(findings, lambda f: F.coalesce(F.endswith(F.lower(f["decision"]), F.lit("block")), F.lit(False)) | (f["score"] >= 0.5))
    blocked = issue & (worst >= min_severity) if block_on_findings else F.lit(False)
    return F.struct(issue.alias("has_issue"), worst.alias("worst"), blocked.alias("blocked"))
