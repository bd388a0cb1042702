"""Rules are written in the Python dialect; Spark evaluates Java patterns. This module bridges the two."""

from __future__ import annotations

import re
from re import _parser
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Numeric flag bits stored with the rules.
FLAG_IGNORECASE = 2
FLAG_MULTILINE = 8
FLAG_DOTALL = 16
FLAG_VERBOSE = 64
FLAG_ASCII = 256

_LEADING_FLAGS = re.compile(r"\(\?([aimsux]+)\)")
_TOKEN = re.compile(r"\\.|\(\?P<(\w+)>|\(\?P=(\w+)\)|\{\d*,?\d*\}|&&|.", re.S)


def _group_name(name: str) -> str:
    """Java group names are letters and digits only."""
    return re.sub(r"[^A-Za-z0-9]", "", name) or "g"


def java_pattern(pattern: str, flags: int = 0) -> str:
    """Java twin of a Python pattern.

    ``U`` makes ``\\d \\w \\s \\b`` Unicode aware as they are for Python strings and ``d`` leaves ``\\n`` as the only
    line end, which is what Python's ``.``, ``^`` and ``$`` look at.
    """
    letters = {"d"} if flags & FLAG_ASCII else {"d", "U"}
    for bit, letter in ((FLAG_IGNORECASE, "i"), (FLAG_MULTILINE, "m"), (FLAG_DOTALL, "s"), (FLAG_VERBOSE, "x")):
        if flags & bit:
            letters.add(letter)
    head = _LEADING_FLAGS.match(pattern)
    if head:
        pattern = pattern[head.end():]
        letters |= set(head[1]) - {"a", "u"}
        if "a" in head[1]:
            letters.discard("U")
    out: list[str] = []
    class_at: int | None = None
    for tok in _TOKEN.finditer(pattern):
        text = tok[0]
        if class_at is not None:
            opening = tok.start() == class_at
            if text == "]" and not opening:
                class_at = None
            elif text in ("[", "&&") or (text == "]" and opening):
                text = "\\" + text if text != "&&" else "&\\&"
            elif text == "^" and opening:
                class_at += 1
        elif text == "[":
            class_at = tok.end()
        elif tok[1]:
            text = f"(?<{_group_name(tok[1])}>"
        elif tok[2]:
            text = f"\\k<{_group_name(tok[2])}>"
        elif text == "\\Z":
            text = "\\z"
        elif text == "{" or (text in ("{}", "{,}")):
            text = text.replace("{", "\\{").replace("}", "\\}")
        elif text.startswith("{,"):
            text = "{0" + text[1:]
        out.append(text)
    return f"(?{''.join(sorted(letters))})" + "".join(out)


@dataclass(frozen=True)
class GroupPattern:
    """A pattern with what precedes the value group captured too, so the group's offset can be computed."""

    pattern: str
    value_index: int


def _has_bare_alternation(pattern: str) -> bool:
    depth, in_class = 0, False
    for tok in re.finditer(r"\\.|.", pattern, re.S):
        ch = tok[0]
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            return True
    return False


def group_pattern(pattern: str, group: str, flags: int = 0) -> GroupPattern | None:
    """Pattern whose group 1 is the text in front of ``group``; None if the group is nested or optional."""
    head = _LEADING_FLAGS.match(pattern)
    lead_flags, body = (head[0], pattern[head.end():]) if head else ("", pattern)
    at = body.find(f"(?P<{group}>")
    if at < 0 or re.search(r"(?<!\\)\\[1-9]", body) or _has_bare_alternation(body):
        return None
    try:
        re.compile(lead_flags + body[:at], flags)
        wrapped = f"{lead_flags}({body[:at]}){body[at:]}"
        compiled = re.compile(wrapped, flags)
    except re.error:
        return None
    closing = _matching_paren(body, at)
    if closing < 0 or body[closing + 1:closing + 2] in ("?", "*", "+", "{"):
        return None
    return GroupPattern(java_pattern(wrapped, flags), compiled.groupindex[group])


def _matching_paren(body: str, at: int) -> int:
    depth, in_class = 0, False
    for tok in re.finditer(r"\\.|.", body, re.S):
        if tok.start() < at:
            continue
        ch = tok[0]
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return tok.start()
    return -1


def may_match_empty(pattern: str, flags: int = 0) -> bool:
    """Whether some match of the pattern can be empty, by the least width of what it's made of."""
    flags &= ~FLAG_ASCII
    return _parser.parse(pattern, flags).getwidth()[0] == 0


# Texts on which a rule must not produce a zero-width hit.
_EMPTY_HIT_SAMPLES = ("", " ", "a", "0", "a b", "0.a-1\n", "가 나")


def rule_problem(pattern: str | None, flags: int = 0) -> str | None:
    """Why a rule cannot be used, judged in the Python dialect it is written in."""
    if not pattern:
        return "empty rule"
    try:
        compiled = re.compile(pattern, flags & ~FLAG_ASCII | (re.ASCII if flags & FLAG_ASCII else 0))
    except (re.error, OverflowError, ValueError) as err:
        return f"does not compile: {err}"
    if any(m.end() == m.start() for s in _EMPTY_HIT_SAMPLES for m in compiled.finditer(s)):
        return "matches empty text"
    return None


def engine_problem(spark: SparkSession, java: str) -> str | None:
    """Compile the translated pattern in Spark itself; a bad pattern would otherwise fail the whole job."""
    try:
        spark.range(1).select(F.lit("").rlike(java).alias("ok")).collect()
    except Exception as err:  # noqa: BLE001 - any failure disqualifies the rule, never the job
        return f"not supported by the engine: {type(err).__name__}"
    return None
