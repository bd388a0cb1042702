"""Accounts seen in requests: keys, ids, first appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import user_key


def account_uuid(key: Column) -> Column:
    """Stable id of an account key, null for none. A random id would change when a task is run again; this one cannot."""
    h = F.sha2(key, 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    spelled = F.concat_ws("-", cut[0], cut[1], F.concat(F.lit("4"), cut[2]), F.concat(F.lit("a"), cut[3]), cut[4])
    return F.when(key.isNotNull(), spelled)


def seen_accounts(requests: DataFrame) -> DataFrame:
    """One row per account key. Partial aggregation: a key with a third of all requests ships one row per task."""
    keyed = requests.withColumn("user_key", user_key(F.col("email"), F.col("ai_service")))
    return keyed.groupBy("user_key").agg(F.min("email").alias("email"), F.min("ai_service").alias("ai_service_id"))


def new_accounts(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Accounts seen but not stored, one row per key."""
    return seen.dropDuplicates(["user_key"]).join(stored.select("user_key"), "user_key", "left_anti")


def assign_uuid(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored id if there is one, else the stable id of the key."""
    known = stored.groupBy("user_key").agg(F.min("id").alias("__id"))
    return seen.join(known, "user_key", "left").withColumn(
        "uuid", F.coalesce("__id", account_uuid(F.col("user_key")))).drop("__id")


def upsert(target: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or update by key: the values of the last new row by ``order`` win, fields it leaves null keep the stored value.

    Of rows with one key and order, the one with the largest hash is the last, whichever task saw it first.
    """
    rows = new.select(*new.columns, F.struct(F.col(order), F.xxhash64(*new.columns)).alias("__at"))
    fresh = rows.groupBy(key).agg(F.max_by(F.struct(*new.columns), "__at").alias("__r")).select("__r.*")
    n, t = fresh.alias("n"), target.alias("t")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) if c in new.columns else F.col(f"t.{c}").alias(c)
            for c in target.columns]
    return t.join(n, F.col(f"t.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def latest_by_key(target: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Last write per key over stored and new rows, by partial aggregation. At a tie new rows go before stored ones, then
    the hash of the row decides."""
    columns = target.columns
    both = target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*columns), F.struct(F.col(order), "__new", F.xxhash64(*columns)))
    return both.groupBy(key).agg(last.alias("__r")).select("__r.*")
