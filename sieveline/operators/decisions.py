"""From filter verdicts to one decision per message.

The verdicts of a message come from a short list of filters, so they are kept as an array in the message's row and the
chain is evaluated there, without a shuffle. The ``*_table`` forms do the same for verdicts stored one per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import pii as P
from sieveline.functions import spans as S
from sieveline.functions import text as X
from sieveline.functions.expr import let
from sieveline.operators.rules import Rule, plan_of, rule_spans
from sieveline.schemas import VERDICT


def verdict(ord_: int, filter_id: str, action: Column, *, masked: Column | None = None, message: Column | None = None,
            code: Column | None = None) -> Column:
    derived = F.when(action == C.BLOCK, C.CODE_BLOCK).when(action == C.MASKING, C.CODE_MASKING).otherwise(C.CODE_ALLOW)
    return F.struct(
        F.lit(ord_).alias("ord"), F.lit(filter_id).alias("filter_id"), action.alias("action"),
        (derived if code is None else code).alias("action_code"),
        (F.lit("") if masked is None else masked).alias("masked_contents"),
        (F.lit("") if message is None else message).alias("block_message")).cast(VERDICT)


def _blocks(v: Column) -> Column:
    return (F.coalesce(v["action_code"], F.lit(C.CODE_ALLOW)) == C.CODE_BLOCK) | F.coalesce(
        v["action"] == C.BLOCK, F.lit(False))


def run_filter_chain(verdicts: Column) -> Column:
    """Verdicts up to and including the first block, in chain order; filters behind it never ran."""
    return let(F.array_sort(verdicts), lambda ordered: let(
        F.array_position(F.transform(ordered, _blocks), True).cast("int"),
        lambda at: F.when(at > 0, F.slice(ordered, F.lit(1), at)).otherwise(ordered)))


def final_decision(verdicts: Column) -> Column:
    """First block wins, else the first masking, else allow: ``struct<action,action_code,masked_contents,block_message>``.

    Decided on the numeric code alone; a verdict without a code counts as allow.
    """
    def choose(ordered: Column) -> Column:
        def first(code: int) -> Column:
            return F.try_element_at(F.filter(ordered, lambda v: v["action_code"] == code), F.lit(1))

        return F.coalesce(first(C.CODE_BLOCK), first(C.CODE_MASKING))

    def result(chosen: Column) -> Column:
        code = F.coalesce(chosen["action_code"], F.lit(C.CODE_ALLOW))
        return F.struct(
            F.when(code == C.CODE_BLOCK, C.BLOCK).when(code == C.CODE_MASKING, C.MASKING).otherwise(C.ALLOW).alias("action"),
            code.alias("action_code"), F.coalesce(chosen["masked_contents"], F.lit("")).alias("masked_contents"),
            F.coalesce(chosen["block_message"], F.lit("")).alias("block_message"))

    return let(let(F.array_sort(verdicts), choose), result)


def skip_after_upstream_block(stages: Column) -> Column:
    """Mark stages behind a block: ``array<struct<ord,filter_id,skipped,skipped_by>>``.

    Input is ``array<struct<ord,filter_id,should_block,action>>``; a stage blocks when it both should and did.
    """
    def blocking(v: Column) -> Column:
        return F.coalesce(v["should_block"], F.lit(False)) & F.coalesce(F.lower(F.trim(v["action"])).startswith("block"), F.lit(False))

    def marked(ordered: Column, first: Column) -> Column:
        return F.transform(ordered, lambda v: F.struct(
            v["ord"].alias("ord"), v["filter_id"].alias("filter_id"),
            F.coalesce(v["ord"] > first["ord"], F.lit(False)).alias("skipped"),
            F.when(v["ord"] > first["ord"], first["filter_id"]).alias("skipped_by")))

    return let(F.array_sort(stages), lambda ordered: let(
        F.try_element_at(F.filter(ordered, blocking), F.lit(1)), lambda first: marked(ordered, first)))


def run_filter_chain_table(verdicts: DataFrame, key: str = "message_id") -> DataFrame:
    """Chain over stored verdicts, one row each.

    ``stops`` has one row per blocked key, so a key with very many verdicts is large on the left side only, and the
    adaptive skew join splits it there.
    """
    stops = verdicts.where(_blocks(F.struct("action", "action_code"))).groupBy(key).agg(F.min("ord").alias("__stop"))
    joined = verdicts.join(stops, key, "left")
    return joined.where(F.col("__stop").isNull() | (F.col("ord") <= F.col("__stop"))).drop("__stop")


def final_decision_table(verdicts: DataFrame, key: str = "message_id", *, stop_at_block: bool = False) -> DataFrame:
    """One row per message by one partial aggregation: each task ships its candidates for a message, not its verdicts.

    With ``stop_at_block`` the filter chain is run on the way: verdicts behind the first block, by code or by name, don't
    count. Nothing has to be joined for that, as the first block's place comes out of the same aggregation.
    """
    entry = F.struct("ord", "masked_contents", "block_message")
    first = lambda test: F.min_by(F.when(test, entry), F.when(test, F.col("ord")))
    found = verdicts.groupBy(key).agg(
        F.min(F.when(_blocks(F.struct("action", "action_code")), F.col("ord"))).alias("__stop"),
        first(F.col("action_code") == C.CODE_BLOCK).alias("__block"), first(F.col("action_code") == C.CODE_MASKING).alias("__mask"))

    def reached(c: str) -> Column:
        there = F.col(c).isNotNull()
        return there & (F.col("__stop").isNull() | (F.col(f"{c}.ord") <= F.col("__stop"))) if stop_at_block else there

    chosen = F.when(reached("__block"), F.col("__block")).when(reached("__mask"), F.col("__mask"))
    code = F.when(reached("__block"), C.CODE_BLOCK).when(reached("__mask"), C.CODE_MASKING).otherwise(C.CODE_ALLOW)
    return found.select(key, chosen.alias("__c"), code.alias("action_code")).select(
        key, F.when(F.col("action_code") == C.CODE_BLOCK, C.BLOCK).when(F.col("action_code") == C.CODE_MASKING, C.MASKING).otherwise(C.ALLOW).alias("action"),
        "action_code", F.coalesce("__c.masked_contents", F.lit("")).alias("masked_contents"), F.coalesce("__c.block_message", F.lit("")).alias("block_message"))


def echo_block_response(decided: DataFrame) -> DataFrame:
    """A blocked prompt answers with its block message, as an output row of its own."""
    return decided.where(F.col("action_code") == C.CODE_BLOCK).select(
        F.col("block_message").alias("llm_output"), "user_id", "email", "ai_service", F.lit("").alias("client_host"),
        "session_id", "message_id")


def union_outputs(outputs: DataFrame, echoes: DataFrame) -> DataFrame:
    return outputs.unionByName(echoes)


def attach_output_to_prompt(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every prompt with its responses; prompts are unique by message id, responses need not be.

    The pairs are an inner join, of which Spark can split a message's many responses; prompts without any are added.
    """
    paired = prompts.join(outputs, "message_id")
    alone = prompts.join(outputs.select("message_id").distinct(), "message_id", "left_anti")
    return paired.unionByName(alone, allowMissingColumns=True)


# --- filters ---------------------------------------------------------------------------------------------------------


def compose_filters(df: DataFrame, filters: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda d, f: d.transform(f), filters, df)


def regex_filter(df: DataFrame, text: str, *, policy: str = "masking", mode: str = "redact", patterns: Sequence[str] = (),
                 block_on_match: bool = True, redact: bool = True, enabled: Sequence[str] = C.PII_ENABLED) -> DataFrame:
    """Adds ``hits, decision, score, reason, should_block, final_action, action, notice, content``.

    ``block`` acts only when blocking is on, otherwise it falls through to masking. A scanner flag without a personal-
    data hit sets ``should_block`` but leaves the final action at ALLOW.
    """
    policy = policy.lower()
    out = df.withColumn("hits", P.detect_pii(F.col(text), enabled=enabled))
    out = out.withColumn("__scan", P.scan_first_match(F.col(text), patterns))
    has = F.size("hits") > 0
    block = P.should_block(has, F.col("__scan.decision"), block_on_match)
    if policy == "block":
        acting = F.when(block, "BLOCK_MSG").otherwise("MASKING_REDACT" if redact else "ALLOW")
    elif policy == "allow":
        acting = F.lit("ALLOW")
    else:
        acting = F.lit("MASKING_REDACT" if redact else "ALLOW")
    final = F.when(has, acting).otherwise("ALLOW")
    out = (out.withColumn("decision", F.col("__scan.decision")).withColumn("score", F.col("__scan.score"))
           .withColumn("reason", F.col("__scan.reason")).withColumn("should_block", block)
           .withColumn("final_action", final).drop("__scan"))
    return (out.withColumn("action", X.std_action(F.col("final_action")))
            .withColumn("notice", F.when(has & (F.col("final_action") != "BLOCK_MSG"), P.build_ui_notice(F.col("hits"), mode)))
            .withColumn("content", F.when(F.col("final_action") == "MASKING_REDACT", P.redact_priority(F.col(text), enabled))
                        .otherwise(F.col(text))))


def rule_filter(df: DataFrame, text: str, rules: Sequence[Rule], *, policy: str = "masking", redact: bool = True) -> DataFrame:
    """Adds ``plan_decision, score, types, match_counts, action, content`` for a rule list under one policy."""
    out = df.withColumn("__plan", plan_of(rule_spans(F.col(text), rules)))
    hit = F.col("__plan.score") > 0
    action = {"block": F.lit(C.BLOCK), "masking": F.lit(C.MASKING) if redact else F.lit(C.ALLOW)}.get(policy, F.lit(C.ALLOW))
    masked = S.apply_replacements(F.col(text), F.col("__plan.replacements"))
    content = {"block": F.lit(f"{C.RULE_BLOCK_LEAD}\n{C.RULE_BLOCK_NOTICE}"), "masking": masked if redact else F.col(text)}
    return (out.withColumn("plan_decision", F.col("__plan.decision")).withColumn("score", F.col("__plan.score"))
            .withColumn("types", F.map_keys("__plan.values_by_type"))
            .withColumn("match_counts", F.transform_values("__plan.values_by_type", lambda _, v: F.size(v)))
            .withColumn("action", F.when(hit, action).otherwise(C.ALLOW))
            .withColumn("content", F.when(hit, content.get(policy, F.col(text))).otherwise(F.col(text))).drop("__plan"))


def latency_stats(df: DataFrame, column: str, *by: str) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("avg"), F.min(c).alias("min"), F.max(c).alias("max"))


def order_filters(filters: DataFrame) -> DataFrame:
    """Filters in chain order: by priority, then id."""
    return filters.withColumn("ord", F.struct("priority", "id")).orderBy("ord")
