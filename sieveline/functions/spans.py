"""Span algebra as column expressions.

A text's spans live in one array inside the text's own row, so finding, resolving and replacing them needs no shuffle
and the size of every array is bounded by the length of that text. Offsets are 0-based, half open, in code points;
``ord`` is the place of the rule among the rules, ``ordinal`` that of the hit among the hits of its rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.expr import BLOCK, let, pick, prefixes
from sieveline.functions.regex import GroupPattern, group_pattern, java_pattern, may_match_empty

SPAN = "struct<start:int,end:int,ord:int,type:string,rule:string,value:string,ordinal:int>"
SPANS = f"array<{SPAN}>"
REPLACEMENTS = "array<struct<start:int,end:int,replacement:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


@dataclass(frozen=True)
class SpanRule:
    """One Python-dialect pattern to look for.

    ``group`` narrows the span to a named group. ``gate`` is a cheap necessary condition (a literal the pattern needs),
    checked before the pattern is.
    """

    pattern: str
    type: str
    rule: str | None = None
    ord: int = 0
    flags: int = 0
    group: str | None = None
    gate: Column | None = None


def _matches(text: Column, r: SpanRule) -> Column:
    """Matches of one rule and the pieces between them; a text without a hit is read once, one with hits twice."""
    # Matches and pieces interleave only if no match is empty.
    if may_match_empty(r.pattern, r.flags):
        raise ValueError(f"rule {r.rule or r.type!r} can match empty text; use operators.rules.spans_in_python")
    java = java_pattern(r.pattern, r.flags)
    lead = value = F.lit(None).cast("array<string>")
    if r.group is not None:
        grouped: GroupPattern | None = group_pattern(r.pattern, r.group, r.flags)
        if grouped is None:
            raise ValueError(f"group {r.group!r} is nested; use operators.rules.spans_in_python")
        java = grouped.pattern
        lead = F.regexp_extract_all(text, F.lit(java), F.lit(1))
        value = F.regexp_extract_all(text, F.lit(java), F.lit(grouped.value_index))

    def with_pieces(found: Column) -> Column:
        hit = F.size(found) > 0
        return F.when(hit, F.struct(
            F.lit(r.ord).alias("ord"), F.lit(r.type).alias("type"), F.lit(r.rule or r.type).alias("rule"), found.alias("found"),
            F.split(text, java, -1).alias("pieces"), lead.alias("lead"), value.alias("value")))

    matched = let(F.regexp_extract_all(text, F.lit(java), F.lit(0)), with_pieces)
    return F.when(text.isNotNull() if r.gate is None else r.gate, matched)


def _place(m: Column) -> Column:
    """Spans of one rule: matches and the pieces between them interleave exactly, which gives their offsets."""
    # One more piece than matches: the last pair has no hit and goes.
    pairs = F.filter(F.zip_with(m["pieces"], m["found"], lambda b, v: F.struct(
        F.length(b).alias("gap"), F.length(v).alias("n"), v.alias("hit"))), lambda o: o["n"].isNotNull())

    def placed(ps: Column) -> Column:
        before = prefixes(ps, F.lit(0), lambda x: x["gap"] + x["n"], lambda a, n: a + n)
        starts = F.zip_with(ps, before, lambda x, at: F.struct((at + x["gap"]).alias("at"), x["hit"].alias("hit")))
        return F.transform(starts, lambda x, i: span(
            x["at"] + F.coalesce(F.length(F.get(m["lead"], i)), F.lit(0)), F.coalesce(F.get(m["value"], i), x["hit"]), i))

    def span(start: Column, value: Column, ordinal: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), m["ord"].alias("ord"), m["type"].alias("type"),
                        m["rule"].alias("rule"), value.alias("value"), ordinal.alias("ordinal"))

    return let(pairs, placed)


def spans_of(text: Column, rules: Sequence[SpanRule]) -> Column:
    """All hits of all rules as ``array<SPAN>``, rule by rule, each in text order."""
    if not rules:
        return no_spans()
    hits = F.array_compact(F.array(*[_matches(text, r) for r in rules]))
    spans = F.flatten(F.transform(hits, _place))
    return F.filter(spans, lambda s: s["start"] < s["end"]).cast(SPANS)


def spans_of_pattern(text: Column, pattern: Column, grouped: Column, value_index: Column, ord_: Column, name: Column) -> Column:
    """All hits of a pattern that is data, as ``array<SPAN>``; ``grouped`` and ``value_index`` are null or a ``GroupPattern``.

    The pattern has no empty match. ``type`` is the lower-cased name.
    """
    whole = F.coalesce(grouped, pattern)

    def with_pieces(found: Column) -> Column:
        narrowed = grouped.isNotNull()
        return F.when(F.size(found) > 0, F.struct(
            ord_.alias("ord"), F.lower(name).alias("type"), name.alias("rule"), found.alias("found"), F.split(text, whole, -1).alias("pieces"),
            F.when(narrowed, F.regexp_extract_all(text, whole, F.when(narrowed, F.lit(1)).otherwise(F.lit(0)))).alias("lead"),
            F.when(narrowed, F.regexp_extract_all(text, whole, F.coalesce(value_index, F.lit(0)))).alias("value")))

    spans = let(F.regexp_extract_all(text, whole, F.lit(0)), lambda found: let(with_pieces(found), lambda m: F.when(m.isNotNull(), _place(m))))
    return F.filter(F.coalesce(spans, F.array()), lambda s: s["start"] < s["end"]).cast(SPANS)


def find_spans(text: Column, pattern: str, type_: str, *, rule: str | None = None, ord_: int = 0,
               flags: int = 0, group: str | None = None, gate: Column | None = None) -> Column:
    """All hits of one pattern; see ``SpanRule``."""
    return spans_of(text, [SpanRule(pattern, type_, rule, ord_, flags, group, gate)])


def islands(spans: Column) -> Column:
    """Split spans, in text order, into runs that don't overlap one another, so that overlap tests stay inside one run.

    With starts and ends sorted apart, a run begins at the i-th start if the i spans before it have all ended by then, which
    is so exactly if the i-th smallest end is no larger. An empty span counts as one place long here.
    """

    def split(ordered: Column, ends: Column) -> Column:
        heads = F.filter(F.transform(ordered, lambda s, i: F.when((i == 0) | (s["start"] >= F.try_element_at(ends, i)), i + 1)), lambda i: i.isNotNull())
        return let(heads, lambda hs: F.transform(hs, lambda at, k: pick(
            ordered, at, F.coalesce(F.try_element_at(hs, k + 2) - 1, F.size(ordered)))))

    return let(F.sort_array(spans), lambda ordered: let(F.sort_array(F.transform(
        ordered, lambda s: F.greatest(s["end"], s["start"] + 1))), lambda ends: split(ordered, ends)))


def _free(kept: Column, s: Column) -> Column:
    """No span of ``kept`` (disjoint, in text order) overlaps ``s``; by binary search for the last that starts before its end."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(31))])

    def last(bits: Column) -> Column:
        return F.aggregate(bits, F.lit(0), lambda at, step: F.when(F.try_element_at(kept, at + step)["start"] < s["end"], at + step).otherwise(at))

    # Starts are tried at places that exist; ends rise with starts, as kept spans are disjoint.
    fitting = F.filter(steps, lambda step: step <= F.size(kept))
    return (F.size(kept) == 0) | let(last(fitting), lambda at: F.when(at == 0, True).otherwise(F.try_element_at(kept, at)["end"] <= s["start"]))


def _greedy(spans: Column, keys: Callable[[Column], Sequence[Column]]) -> Column:
    """Take spans in key order, keep each that overlaps none kept so far; result in text order.

    Spans are taken in blocks of sqrt(n): those free of what earlier blocks kept are found by binary search, overlaps inside
    a block by comparison, and what the block adds is sorted in. So an island of n spans costs n^1.5 cheap steps.
    """

    def rank(s: Column) -> Column:
        return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys(s))], s.alias("span"))

    def block_size(run: Column) -> Column:
        return F.greatest(F.lit(BLOCK), F.sqrt(F.size(run)).cast("int"))

    def in_turn(ranked: Column, none: Column) -> Column:
        return F.aggregate(ranked, none, lambda kept, r: F.when(
            F.exists(kept, lambda k: (k["start"] < r["span"]["end"]) & (r["span"]["start"] < k["end"])), kept
        ).otherwise(F.concat(kept, F.array(r["span"]))))

    def in_blocks(ranked: Column, none: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(ranked), block_size(ranked)), lambda at: pick(
            ranked, at, F.least(at + block_size(ranked) - 1, F.size(ranked))))
        return F.aggregate(blocks, none, lambda kept, block: F.sort_array(F.concat(
            kept, in_turn(F.filter(block, lambda r: _free(kept, r["span"])), none))))

    def take(run: Column) -> Column:
        return let(F.sort_array(F.transform(run, rank)), lambda ranked: let(F.slice(run, 1, 0), lambda none: F.when(
            F.size(ranked) <= BLOCK, in_turn(ranked, none)).otherwise(in_blocks(ranked, none))))

    def resolved(all_: Column) -> Column:
        kept = F.transform(islands(all_), lambda run: F.when(F.size(run) == 1, run).otherwise(take(run)))
        return F.when(F.size(all_) <= 1, all_).otherwise(F.sort_array(F.flatten(kept)))

    return let(spans, resolved)


def resolve_longest(spans: Column) -> Column:
    """Longest span wins; among equals the earlier start, then the earlier rule."""
    return _greedy(spans, lambda s: (s["start"] - s["end"], s["start"], s["ord"]))


def resolve_priority(spans: Column) -> Column:
    """Rules are applied in ``ord`` order, each left to right; a later rule never cuts into an earlier hit."""
    return _greedy(spans, lambda s: (s["ord"], s["start"]))


def merge_spans(spans: Column) -> Column:
    """Union of overlapping or touching spans as ``array<struct<start,end>>``.

    Starts and ends are sorted apart: a region begins at a start that lies behind the end in front of it, and ends at an end
    that lies in front of the next start (see ``islands``).
    """

    def merged(starts: Column, ends: Column) -> Column:
        first = F.filter(starts, lambda s, i: (i == 0) | (s > F.try_element_at(ends, i)))
        last = F.filter(ends, lambda e, i: (i == F.size(starts) - 1) | (F.try_element_at(starts, i + 2) > e))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    def sides(all_: Column) -> Column:
        return let(F.sort_array(F.transform(all_, lambda s: s["start"])), lambda starts: let(
            F.sort_array(F.transform(all_, lambda s: s["end"])), lambda ends: merged(starts, ends)))

    return let(spans, sides)


def build_replacements(spans: Column) -> Column:
    """Each span is to be replaced by its rule name in brackets."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.concat(F.lit("["), s["rule"], F.lit("]")).alias("replacement")))


def values_by_type(spans: Column) -> Column:
    """Distinct values per type, both in order of first appearance."""

    def grouped(all_: Column) -> Column:
        types = F.array_distinct(F.transform(all_, lambda s: s["type"]))
        return let(types, lambda ts: F.map_from_arrays(ts, F.transform(ts, lambda t: F.array_distinct(
            F.transform(F.filter(all_, lambda s: s["type"] == t), lambda s: s["value"])))))

    return let(spans, grouped)


def apply_replacements(text: Column, replacements: Column) -> Column:
    """Rewrite a text by disjoint replacements (any order)."""

    def size_of(ordered: Column) -> Column:
        return F.greatest(F.lit(BLOCK), F.sqrt(F.size(ordered)).cast("int"))

    def region(t: Column, ordered: Column, at: Column) -> Column:
        """Text from behind replacement ``at - 1`` up to the end of the block starting at ``at``, rewritten."""
        base = F.when(at == 1, F.lit(0)).otherwise(F.try_element_at(ordered, at - 1)["end"])

        def within(block: Column, base: Column) -> Column:
            def piece(part: Column) -> Column:
                def one(r: Column, i: Column) -> Column:
                    before = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(block, i)["end"] - base)
                    return F.concat(F.substring(part, before + 1, r["start"] - base - before), r["replacement"])

                return F.array_join(F.transform(block, one), "")

            return let(F.substring(t, base + 1, F.element_at(block, -1)["end"] - base), piece)

        last = F.least(at + (size_of(ordered) - 1), F.size(ordered))
        return let(pick(ordered, at, last), lambda block: let(base, lambda b: within(block, b)))

    def rebuilt(t: Column, ordered: Column) -> Column:
        # A substring is counted from the start of its text, so it is taken from short regions, not from the whole.
        # With blocks of sqrt(n) replacements, finding the regions and working inside them cost the same.
        starts = F.sequence(F.lit(1), F.size(ordered), size_of(ordered))
        tail_from = F.try_element_at(ordered, F.lit(-1))["end"]
        return F.concat(F.array_join(F.transform(starts, lambda at: region(t, ordered, at)), ""),
                        F.substring(t, tail_from + 1, F.length(t)))

    return let(text, lambda t: let(F.sort_array(replacements), lambda ordered: F.when(
        F.coalesce(F.size(ordered), F.lit(0)) > 0, rebuilt(t, ordered)).otherwise(t)))


def mask_merged(text: Column, spans: Column, token: str = "[MASKING]") -> Column:
    """One token per merged region."""
    return apply_replacements(text, F.transform(merge_spans(spans), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(token).alias("replacement"))))


def mask_entities(text: Column, entities: Column, char: str = "*") -> Column:
    """Overwrite tagger entities ``array<struct<word,start,end,entity_group>>`` by ``char`` times the word's length.

    As if applied from the last start to the first, where an entity that reaches into a later one cuts into its mask. Read
    from the left, entity k begins where its predecessors have used the text up to: ``used(k + 1) = max(end, used(k) + end -
    start - length)``. Such steps compose, so one prefix scan gives all places, and the text is rebuilt once.
    """
    ordered = F.sort_array(F.transform(entities, lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), F.length(e["word"]).alias("n"))))

    def step(least: Column, more: Column) -> Column:
        return F.struct(least.cast("long").alias("least"), more.cast("long").alias("more"))

    def edits(es: Column) -> Column:
        before = prefixes(es, step(F.lit(-(1 << 40)), F.lit(0)), lambda e: step(e["end"], e["end"] - e["start"] - e["n"]),
                          lambda a, b: step(F.greatest(b["least"], a["least"] + b["more"]), a["more"] + b["more"]))
        return F.zip_with(es, before, lambda e, p: let(F.greatest(p["least"], p["more"]).cast("int"), lambda used: F.struct(
            F.greatest(e["start"], used).alias("start"), F.greatest(e["end"], used + e["end"] - e["start"] - e["n"]).alias("end"),
            F.repeat(F.lit(char), F.greatest(e["n"] - F.greatest(used - e["start"], F.lit(0)), F.lit(0))).alias("replacement"), used.alias("used"), e["start"].alias("from"))))

    def by_piece(t: Column, es: Column) -> Column:
        # A mask longer than its entity can bring used text back: pieces are then not disjoint.
        pieces = F.transform(es, lambda e: F.concat(F.substring(t, e["used"] + 1, F.greatest(e["from"] - e["used"], F.lit(0))), e["replacement"]))
        return F.concat(F.array_join(pieces, ""), let(F.element_at(es, -1)["end"], lambda used: F.substring(t, used + 1, F.length(t))))

    def rebuilt(t: Column, es: Column) -> Column:
        disjoint = F.forall(es, lambda e: e["end"] >= e["start"])
        return F.when(disjoint, apply_replacements(t, F.transform(es, lambda e: F.struct(e["start"], e["end"], e["replacement"])))).otherwise(by_piece(t, es))

    return let(text, lambda t: let(edits(ordered), lambda es: F.when(F.size(es) > 0, rebuilt(t, es)).otherwise(t)))


def list_entities(entities: Column) -> Column:
    """Entities as ``array<struct<word,type,position>>``."""
    return F.transform(entities, lambda e: F.struct(
        e["word"].alias("word"), F.coalesce(e["entity_group"], F.lit("UNKNOWN")).alias("type"),
        F.concat_ws("-", e["start"], e["end"]).alias("position")))
