"""Rules as data: validation, text-by-rule matching, detection plans.

A rule table is written by administrators, so it is small next to the texts. A few rules are unrolled into literal patterns
(compiled once per task) and tested inside the text's own row: no join, no shuffle, no pair that is not a hit. Of many
rules, those that cannot match without some literal are looked for all at once by an automaton over the literals; only the
rules it names for a text are tried on it, as rows of text and rule joined to the broadcast patterns. The others are unrolled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import spans as S
from sieveline.functions.expr import let, unnest
from sieveline.functions.literals import automaton, mandatory, named
from sieveline.functions.regex import engine_problem, group_pattern, java_pattern, may_match_empty, rule_problem
from sieveline.functions.text import decode_rule

#: Rules unrolled into one array expression, and rules a table may have at most: more is an error, never a cut.
RULES_PER_ARRAY, MOST_RULES = 200, 50_000
#: Up to this many rules are cheaper unrolled than named by an automaton.
FEW_RULES = 24
RULE_COLUMNS = ("ord", "id", "name", "rule", "action", "regex_flag", "regex_group_val")
DOTALL = 16


@dataclass(frozen=True)
class Rule:
    ord: int
    id: str
    name: str
    rule: str
    action: str = ""
    flags: int = 0
    group: str | None = None

    def matches(self, text: Column) -> Column:
        return text.rlike(java_pattern(self.rule, self.flags))

    def header(self) -> Column:
        return F.struct(F.lit(self.ord).alias("ord"), F.lit(self.id).alias("rule_id"), F.lit(self.name).alias("name"),
                        F.lit(self.action).alias("action"))


HIT_COLUMNS = ("ord", "rule", "ordinal", "start", "end", "value")
HEADER = "struct<ord:int,rule_id:string,name:string,action:string>"


def as_rules(rows: Iterable[Sequence | dict]) -> list[Rule]:
    """Rules from ``(name, rule, action, flags, group)`` tuples, in order."""
    return [Rule(i, str(i), name, rule, action, flags, group) for i, (name, rule, action, flags, group) in enumerate(rows)]


def normalize_rules(rules: DataFrame) -> DataFrame:
    """Any rule table in the column layout used here; a rule without flags is matched with DOTALL."""
    have = set(rules.columns)

    def col(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default).alias(name) if name in have else default.alias(name)

    return rules.select(
        col("ord", F.lit(0)), F.col("id").cast("string").alias("id"), col("name", F.lit("UNNAMED")), "rule",
        col("action", F.lit("")), col("regex_flag", F.lit(DOTALL)),
        (F.col("regex_group_val") if "regex_group_val" in have else F.lit(None).cast("string")).alias("regex_group_val"))


def load_rules(rules: DataFrame, most: int = MOST_RULES) -> list[Rule]:
    """All rules of a table, in an order of all columns, so that equal and null keys are in it as well."""
    rows = normalize_rules(rules).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules; texts are matched with a table that administrators write")
    rows.sort(key=lambda r: tuple((v is not None, v) for v in r))
    return [Rule(r.ord, r.id, r.name, r.rule, r.action, r.regex_flag, r.regex_group_val) for r in rows]


def _arrays(rules: DataFrame | Sequence[Rule], array: Callable[[Sequence[Rule]], Column], kind: str) -> Column:
    """One array for all rules, put together from arrays of a bounded number of rules each."""
    rows = load_rules(rules) if isinstance(rules, DataFrame) else list(rules)
    parts = [array(rows[i:i + RULES_PER_ARRAY]) for i in range(0, len(rows), RULES_PER_ARRAY)]
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(kind)


# --- loading ---------------------------------------------------------------------------------------------------------


def decode_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with their base64 text decoded, rules that cannot be decoded)."""
    decoded = rules.withColumn("__text", decode_rule(F.col("rule")))
    good = decoded.where(F.col("__text").isNotNull()).withColumn("rule", F.col("__text")).drop("__text")
    return good, decoded.where(F.col("__text").isNull()).drop("__text")


@F.pandas_udf(T.StringType())
def _problem(rule: pd.Series, flags: pd.Series) -> pd.Series:
    return pd.Series([rule_problem(r, int(f)) for r, f in zip(rule, flags)], dtype=object)


def quarantine_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rules, unusable rules with the reason). One bad rule never takes others with it."""
    flags = F.coalesce(F.col("regex_flag"), F.lit(DOTALL)) if "regex_flag" in rules.columns else F.lit(0)
    judged = rules.withColumn("problem", _problem(F.col("rule"), flags))
    return judged.where(F.col("problem").isNull()).drop("problem"), judged.where(F.col("problem").isNotNull())


def engine_checked(spark: SparkSession, rules: Sequence[Rule]) -> tuple[list[Rule], list[tuple[Rule, str]]]:
    """Rules Spark can compile, and the others with the reason; all are tried at once, singly only on failure."""
    patterns = [java_pattern(r.rule, r.flags) for r in rules]
    try:
        spark.range(1).select(*[F.lit("").rlike(p).alias(f"r{i}") for i, p in enumerate(patterns)]).collect()
        return list(rules), []
    except Exception:  # noqa: BLE001 - one of them is bad; find out which
        problems = [engine_problem(spark, p) for p in patterns]
    return ([r for r, p in zip(rules, problems) if p is None], [(r, p) for r, p in zip(rules, problems) if p is not None])


def custom_patterns(rules: DataFrame, patterns: Sequence[str], action: str = "block") -> DataFrame:
    """User patterns appended behind the existing rules, case-insensitive."""
    spark = rules.sparkSession
    table = normalize_rules(rules)
    top = table.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
    extra = spark.createDataFrame(
        [(i, f"custom-{i}", f"custom-{i}", p, action, 2, None) for i, p in enumerate(patterns)],
        "ord int, id string, name string, rule string, action string, regex_flag int, regex_group_val string")
    return table.unionByName(extra.withColumn("ord", (F.col("ord") + 1 + top).cast("int")))


# --- matching --------------------------------------------------------------------------------------------------------


def matching_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """Rules that occur in the text as ``array<struct<ord,rule_id,name,action>>``."""
    return F.array_compact(F.array(*[F.when(r.matches(text), r.header()) for r in rules])).cast(f"array<{HEADER}>")


def first_matching_rule(text: Column, rules: Sequence[Rule]) -> Column:
    """First rule, in order, that occurs in the text; later rules are not tried once one matched."""
    return F.coalesce(*[F.when(r.matches(text), r.header()) for r in sorted(rules, key=lambda r: r.ord)],
                      F.lit(None).cast(HEADER))


def rule_spans(text: Column, rules: Sequence[Rule], *, lower_type: bool = True) -> Column:
    """All hits of all rules; ``type`` is the lower-cased rule name."""
    return S.spans_of(text, [S.SpanRule(r.rule, r.name.lower() if lower_type else r.name, rule=r.name, ord=r.ord, flags=r.flags,
                                        group=r.group) for r in rules])


def _indexed(rules: Sequence[Rule], few: int) -> tuple[list[tuple[Rule, frozenset[str]]], list[Rule]]:
    """(rules with the literals they need, the others); none of the first kind if there are few rules."""
    if len(rules) <= few:
        return [], list(rules)
    needed = [mandatory(r.rule, r.flags) for r in rules]
    return ([(r, n) for r, n in zip(rules, needed, strict=True) if n is not None], [r for r, n in zip(rules, needed, strict=True) if n is None])


NAMED = "struct<ord:int,rule_id:string,name:string,action:string,pattern:string,grouped:string,value:int>"


def _named(df: DataFrame, keys: Sequence[str], text: str, rules: Sequence[tuple[Rule, frozenset[str]]], every_text: bool) -> DataFrame:
    """Keys, ``__text`` and ``__named``: the rules one of whose literals the text has, with their patterns for the engine.

    Texts without any are left out unless ``every_text``.
    """
    rows = []
    for r, _ in rules:
        grouped = group_pattern(r.rule, r.group, r.flags) if r.group is not None else None
        rows.append({"ord": r.ord, "rule_id": r.id, "name": r.name, "action": r.action, "pattern": java_pattern(r.rule, r.flags),
                     "grouped": grouped and grouped.pattern, "value": grouped and grouped.value_index})
    # At most MOST_RULES rules.
    shared = df.sparkSession.sparkContext.broadcast(([needed for _, needed in rules], rows))
    fields = {f.name: f for f in df.schema.fields}
    ddl = ", ".join([*(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys), f"__text string, __named array<{NAMED}>"])
    kind = pa.struct([("ord", pa.int32()), *((c, pa.string()) for c in ("rule_id", "name", "action", "pattern", "grouped")), ("value", pa.int32())])

    def look(batches: Iterable[pa.RecordBatch]):
        literals, table = shared.value
        machine, table = automaton(literals), pa.array(table, kind)
        for batch in batches:
            found = [[] if t is None else named(machine, t) for t in batch.column(len(keys)).to_pylist()]
            if not every_text:
                some = [i for i, f in enumerate(found) if f]
                batch, found = batch.take(pa.array(some, pa.int64())), [found[i] for i in some]
            ends = np.cumsum([0, *map(len, found)])
            flat = table.take(pa.array([i for f in found for i in f], pa.int64()))
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*keys, "__text", "__named"])

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(look, ddl)


def join_text_rules(df: DataFrame, keys: Sequence[str], text: str, rules: DataFrame | Sequence[Rule], few: int = FEW_RULES) -> DataFrame:
    """One row per text and rule that occurs in it. Of more than ``few`` rules those with literals are named by an automaton."""
    rows = load_rules(rules) if isinstance(rules, DataFrame) else list(rules)
    indexed, others = _indexed(rows, few)
    kind = f"array<{HEADER}>"
    if not indexed:
        return unnest(df, keys, _arrays(others, lambda part: matching_rules(F.col(text), part), kind), "ord")
    hits = F.transform(F.filter("__named", lambda r: F.regexp_like("__text", r["pattern"])), lambda r: F.struct(
        *[r[c].alias(c) for c in ("ord", "rule_id", "name", "action")])).cast(kind)
    if others:
        hits = F.concat(hits, _arrays(others, lambda part: matching_rules(F.col("__text"), part), kind))
    return unnest(_named(df, keys, text, indexed, bool(others)), keys, hits, "ord")


def detect_rules(df: DataFrame, keys: Sequence[str], text: str, rules: DataFrame | Sequence[Rule], few: int = FEW_RULES) -> DataFrame:
    """One row per hit: keys, rule, ordinal of the hit within text and rule, offsets, value. ``few`` as for ``join_text_rules``."""
    rows = load_rules(rules) if isinstance(rules, DataFrame) else list(rules)
    is_hard = [may_match_empty(r.rule, r.flags) or (r.group is not None and group_pattern(r.rule, r.group, r.flags) is None) for r in rows]
    hard = [r for r, h in zip(rows, is_hard, strict=True) if h]
    indexed, others = _indexed([r for r, h in zip(rows, is_hard, strict=True) if not h], few)

    def hits(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in HIT_COLUMNS]))

    kind = "array<struct<ord:int,rule:string,ordinal:int,start:int,end:int,value:string>>"
    where, at = (df, text) if not indexed else (_named(df, keys, text, indexed, bool(others)), "__text")
    spans = _arrays(others, lambda part: hits(rule_spans(F.col(at), part)), kind)
    if indexed:
        named_spans = F.transform("__named", lambda r: hits(S.spans_of_pattern(F.col(at), r["pattern"], r["grouped"], r["value"], r["ord"], r["name"])))
        spans = F.concat(F.flatten(named_spans).cast(kind), spans) if others else F.flatten(named_spans).cast(kind)
    found = unnest(where, keys, spans, "ord")
    return found.unionByName(spans_in_python(df, keys, text, hard)) if hard else found


def detect_plan(text: Column, rules: Sequence[Rule]) -> Column:
    """``struct<decision,score,reason,values_by_type,spans_all,replacements>``."""
    return plan_of(rule_spans(text, rules))


def plan_of(spans: Column) -> Column:
    """Detection plan of raw spans."""
    return let(spans, lambda raw: let(S.resolve_longest(raw), lambda final: _plan(raw, final)))


def _plan(raw: Column, final: Column) -> Column:
    hit = F.size(raw) > 0
    return F.struct(
        F.when(hit, "FLAG").otherwise("ALLOW").alias("decision"), F.when(hit, 1.0).otherwise(0.0).alias("score"),
        F.when(hit, "pii detected").otherwise("no match").alias("reason"), S.values_by_type(final).alias("values_by_type"),
        raw.alias("spans_all"), S.build_replacements(final).alias("replacements"))


def test_rule(df: DataFrame, keys: Sequence[str], text: str, rule: str, action: str, flags: int = 0) -> DataFrame:
    """Try one ad-hoc rule on prompts: every prompt with its hit count and resulting action."""
    probe = Rule(0, "test", "test", rule, action, flags)
    problem = rule_problem(rule, flags)
    if problem is not None:
        raise ValueError(problem)
    n = F.regexp_count(F.col(text), F.lit(java_pattern(rule, flags)))
    return df.select(*keys, n.alias("hits"), F.when(probe.matches(F.col(text)), action).otherwise("allow").alias("action"))


test_rule.__test__ = False  # not a test case, whatever its name


def spans_in_python(df: DataFrame, keys: Sequence[str], text: str, rules: Sequence[Rule]) -> DataFrame:
    """Hits (``HIT_COLUMNS``) of rules whose offsets a JVM expression cannot give: a nested or optional group, or a pattern of
    which some matches are empty. Empty matches are no hits.

    Only texts that one of the rules matches, found in the JVM, are handed to Python.
    """
    fields = {f.name: f for f in df.schema.fields}
    key_ddl = ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys)
    given = [(r.ord, r.name, r.rule, r.flags, r.group or 0) for r in rules]

    def scan(batches):
        compiled = [(ord_, name, re.compile(pattern, flags), group) for ord_, name, pattern, flags, group in given]
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                for ord_, name, pattern, group in compiled:
                    found = [m for m in pattern.finditer(row[-1]) if m.start(group) < m.end(group)]
                    rows += [(*row[:-1], ord_, name, i, m.start(group), m.end(group), m[group]) for i, m in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*keys, *HIT_COLUMNS])

    any_rule = reduce(lambda a, b: a | b, [r.matches(F.col(text)) for r in rules])
    return df.where(any_rule).select(*keys, text).mapInPandas(
        scan, f"{key_ddl}, ord int, rule string, ordinal int, start int, `end` int, value string")


def first_hit_per_text(hits: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """First hit per text by rule order; a partial aggregate, so a text with very many hits costs one row per task."""
    first = F.min_by(F.struct(*values), F.col(order)).alias("__first")
    return hits.groupBy(key).agg(first).select(key, "__first.*")


def top_values_per_type(hits: DataFrame, keys: Sequence[str], type_: str, value: str, position: str, n: int = 5) -> DataFrame:
    """First ``n`` distinct values per key and type by position of first appearance.

    ``row_number`` with a bound becomes a per-task limit before the shuffle, so a hot key ships ``n`` rows per task.
    """
    from pyspark.sql import Window as W

    first = hits.groupBy(*keys, type_, value).agg(F.min(position).alias("first_at"))
    w = W.partitionBy(*keys, type_).orderBy("first_at", value)
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
