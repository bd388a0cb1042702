"""Policy tables: rules, filters, bindings and users joined into the rules that apply to a request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions.regex import FLAG_DOTALL, FLAG_IGNORECASE, FLAG_MULTILINE, FLAG_VERBOSE


def order_rules(rules: DataFrame) -> DataFrame:
    """Rules ranked by action, descending as text (masking, block, accept); within an action the id decides.

    The rank of the action, not a row number, is stored: numbering rows would pull the table through one task, while
    only one row per action is ranked here. A rule without an action has no rank.
    """
    ranks = rules.select(F.col("action").alias("__action")).where("__action IS NOT NULL").distinct().withColumn(
        "ord", F.dense_rank().over(W.orderBy(F.desc("__action"))) - 1)
    return rules.join(ranks, F.col("action") == F.col("__action"), "left").drop("__action")


def join_bindings_rules(bindings: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings with their rule, bindings whose rule does not exist)."""
    r = rules.withColumnRenamed("id", "policy_rule_id")
    b = bindings.withColumnRenamed("id", "binding_id")
    return b.join(r, "policy_rule_id"), b.join(r.select("policy_rule_id"), "policy_rule_id", "left_anti")


def join_filters_bindings(filters: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bindings of the listed filters; a filter without bindings is not in the result."""
    return bindings.join(filters.select(F.col("id").alias("filter_id")), "filter_id")


def filters_in_use(filters: DataFrame, bindings: DataFrame) -> DataFrame:
    return filters.join(bindings.select(F.col("filter_id").alias("id")), "id", "left_semi")


def join_user_scope(bound: DataFrame, users: DataFrame) -> DataFrame:
    """User-scoped rules get the user's row; other scopes, and unknown users, keep null.

    Only user-scoped rows are joined: the others, most of them without a subject, would all meet under one key.
    """
    u = users.select(F.col("id").alias("__uid"), F.struct(*users.columns).alias("subject_val"))
    named = F.coalesce(F.col("scope") == "user", F.lit(False)) & F.col("subject_id").isNotNull()
    joined = bound.where(named).join(u, F.col("subject_id") == F.col("__uid"), "left").drop("__uid")
    return joined.unionByName(bound.where(~named).withColumn("subject_val", F.lit(None).cast(joined.schema["subject_val"].dataType)))


def inline_flags(flags: Column) -> Column:
    """Numeric flag bits as inline flags of a pattern."""
    bits = [(FLAG_IGNORECASE, "i"), (FLAG_MULTILINE, "m"), (FLAG_DOTALL, "s"), (FLAG_VERBOSE, "x")]
    letters = F.concat(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, letter).otherwise("") for bit, letter in bits])
    return F.when(letters == "", "").otherwise(F.concat(F.lit("(?"), letters, F.lit(")")))


def compile_scope_map(bound: DataFrame) -> DataFrame:
    """One row per filter, scope and rule with flag and group defaults; a rule without flags is DOTALL.

    The subject stays with the rule for every scope but ``default``.
    """
    flags = F.coalesce(F.col("regex_flag"), F.lit(FLAG_DOTALL))
    return bound.where(F.col("scope").isin(*C.SCOPES)).select(
        "filter_id", "scope", "ord", F.col("policy_rule_id").alias("id"), "name", "rule", "action",
        flags.alias("regex_flag"), F.coalesce("regex_group", F.lit(0)).alias("regex_group"), "regex_group_val",
        inline_flags(flags).alias("inline_flags"),
        F.when(F.col("scope") != "default", F.col("subject_id")).alias("subject_id"))


def in_scopes(scope_map: DataFrame, scopes: Sequence[str] = ("default",)) -> DataFrame:
    """File and safety filters look at the default scope only, unless told otherwise."""
    return scope_map.where(F.col("scope").isin(*scopes))


def rule_count(scope_map: DataFrame) -> DataFrame:
    return scope_map.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"))


def effective_rules(requests: DataFrame, scope_map: DataFrame, *, message_id: str = "message_id", user: str = "user_uuid",
                    service: str = "ai_service", group: str = "user_group_id") -> DataFrame:
    """Rules that apply to single requests through their user, service or group, ranked in that order.

    Default rules apply to every request alike and are not repeated for each: ``default_rules`` gives them once. Each scope
    is a join of its own. Users are many and even; services and groups are few, so their rules are first packed into one
    row per subject, which leaves the side that a hot subject's requests are joined to small.
    """
    rules = scope_map.select("scope", "subject_id", "filter_id", F.col("ord"), F.col("id").alias("rule_id"), "action")
    out = None
    for rank, (scope, subject) in enumerate((("user", user), ("service", service), ("group", group))):
        entry = F.struct(F.lit(rank).alias("scope_rank"), "scope", "filter_id", "ord", "rule_id", "action")
        packed = rules.where(F.col("scope") == scope).groupBy("subject_id").agg(F.collect_list(entry).alias("__rules"))
        asked = requests.select(message_id, F.col(subject).cast("string").alias("subject_id")).where(F.col("subject_id").isNotNull())
        part = asked.join(packed, "subject_id").select(message_id, F.inline("__rules"))
        out = part if out is None else out.unionByName(part)
    return out


def default_rules(scope_map: DataFrame) -> DataFrame:
    """Rules that apply to every request, once, in the columns of ``effective_rules``."""
    return scope_map.where(F.col("scope") == "default").select(
        F.lit(3).alias("scope_rank"), "scope", "filter_id", "ord", F.col("id").alias("rule_id"), "action")


def policy_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules added, removed or modified per filter and scope; a new name alone is no change.

    A filter's scope for which ``new`` has no rule at all is unchanged. Counts matter: the same rule bound twice is another
    policy than bound once.
    """
    def side(df: DataFrame, old_: int, new_: int) -> DataFrame:
        return df.select(*_RULE_KEYS, "action", "rule", F.lit(old_).alias("old"), F.lit(new_).alias("new"))

    return diff_of_sides(side(old, 1, 0).unionByName(side(new, 0, 1)))


_RULE_KEYS = ("filter_id", "scope", "id")


def diff_of_sides(sides: DataFrame) -> DataFrame:
    """``policy_diff`` of one table that holds both policies: columns ``old`` and ``new`` count a row for either side."""
    # Hash aggregations over plain counts; grouping treats nulls as equal, as the comparison must.
    variants = sides.groupBy(*_RULE_KEYS, "action", "rule").agg(F.sum("old").alias("o"), F.sum("new").alias("n"))
    rules = variants.groupBy(*_RULE_KEYS).agg(F.sum("o").alias("o"), F.sum("n").alias("n"), F.bool_or(F.col("o") != F.col("n")).alias("differs"))
    listed = rules.where(F.col("n") > 0).select(F.col("filter_id").alias("__f"), F.col("scope").alias("__s")).distinct()
    change = F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").when(F.col("differs"), "modified")
    changed = rules.select(*_RULE_KEYS, change.alias("change")).where(F.col("change").isNotNull())
    return changed.join(listed, F.col("filter_id").eqNullSafe(F.col("__f")) & F.col("scope").eqNullSafe(F.col("__s")), "left_semi")


def policy_changed(old: DataFrame, new: DataFrame) -> bool:
    return not policy_diff(old, new).isEmpty()
