"""Stored conversations, one row per turn: lookups and edits without an array of a conversation's turns.

Lookups are partial aggregations, so a conversation with any number of turns costs a task one row. Edits pass every turn
on where it is; only system messages, or one row per conversation, are joined with what is known of the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import catalog as C


def last_text(role: str | None = None, *, turn: str = "turn", text: str = "text") -> Column:
    """Aggregate: text of the latest turn (of a role)."""
    if role is None:
        return F.max_by(text, turn)
    own = F.col("role") == role
    return F.max_by(F.when(own, F.col(text)), F.when(own, F.col(turn)))


def system_text(*, turn: str = "turn", text: str = "text") -> Column:
    """Aggregate: text of the first system message."""
    own = F.col("role") == "system"
    return F.min_by(F.when(own, F.col(text)), F.when(own, F.col(turn)))


def without_system(long: DataFrame) -> DataFrame:
    return long.where(F.col("role") != "system")


def pop_system(long: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Per conversation: text of its first system message, and how many turns of other roles it has."""
    return long.groupBy(key).agg(system_text().alias("system"), F.count_if(F.col("role") != "system").alias("n_rest"))


def _front(known: DataFrame, content: Column, key: str) -> DataFrame:
    """A system message in front of each conversation of ``known`` (``key, first``)."""
    return known.select(key, (F.col("first") - 1).alias("turn"), F.lit("system").alias("role"), content.alias("text"))


def upsert_system(long: DataFrame, content: Column, *, key: str = "conv_id") -> DataFrame:
    """A leading system message gets the text put in front of its own; otherwise one is put in front of the conversation."""
    rows = long.select(key, "turn", "role", "text")
    heads = rows.groupBy(key).agg(F.min("turn").alias("first"), F.min_by("role", "turn").alias("lead"))
    led = heads.where(F.col("lead") == "system").select(F.col(key).alias("__key"), "first")
    systems = rows.where(F.col("role") == "system")
    text = F.when(F.col("turn") == F.col("first"), F.concat(content, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    edited = systems.join(led, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, "turn", "role", text.alias("text"))
    others = rows.where(~F.coalesce(F.col("role") == "system", F.lit(False)))
    return others.unionByName(edited).unionByName(_front(heads.where(~F.coalesce(F.col("lead") == "system", F.lit(False))), content, key))


def ensure_language(long: DataFrame, needed: Column, *, key: str = "conv_id", prompt: str = C.LANGUAGE_PROMPT,
                    marker: str = C.LANGUAGE_MARKER) -> DataFrame:
    """The language instruction in front of each conversation of which some turn needs it (``needed``, of a turn), unless a
    system message already carries the marker word."""
    rows = long.select(key, "turn", "role", "text")
    told = F.bool_or((F.col("role") == "system") & F.coalesce(F.contains("text", F.lit(marker)), F.lit(False)))
    known = rows.groupBy(key).agg(F.min("turn").alias("first"), F.bool_or(needed).alias("need"), told.alias("told"))
    wanted = known.where(F.col("need") & ~F.coalesce("told", F.lit(False)))
    return rows.unionByName(_front(wanted, F.lit(prompt), key))
