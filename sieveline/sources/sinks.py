"""Writing audit tables, accounts and logs through Spark's commit protocol.

``sink_idempotent_create`` (for rows with a key), ``sink_upsert_latest`` and ``sink_account_upsert`` can be run again with
the same rows; ``sink_audit_jsonl``, ``sink_account_insert`` and ``sink_prompt_log`` append what they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sieveline.operators.accounts import latest_by_key, upsert
from sieveline.sources.keyed_table import KeyedTable

#: Lines of one file; audit documents are a few hundred bytes.
RECORDS_PER_FILE = 1_000_000


def sink_audit_jsonl(docs: DataFrame, base: str, mode: str = "append", records_per_file: int = RECORDS_PER_FILE,
                     buckets: int | None = None) -> None:
    """One JSON line per document under ``base/index=…/date=…``, at most ``records_per_file`` per file.

    ``docs`` has ``index, date, doc``. Without ``buckets`` nothing is shuffled, and each task writes the folders its rows
    belong to; with it, a folder gets at most that many files, which large writes want.
    """
    if buckets:
        docs = docs.withColumn("__b", F.pmod(F.xxhash64(F.to_json("doc")), F.lit(buckets))).repartition("index", "date", "__b")
    flat = docs.select("index", "date", F.to_json("doc").alias("value"))
    flat.write.mode(mode).partitionBy("index", "date").option("maxRecordsPerFile", records_per_file).text(base)


def document_id(message_id: Column, kind: str = "query") -> Column:
    return F.when(message_id != "", F.concat(message_id, F.lit(f":{kind}")))


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if there is none yet. Any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def create_only(new: DataFrame, stored: DataFrame | None, key: str, order: str | None = None) -> DataFrame:
    """Rows whose key is not stored yet, the first per key by ``order`` and then by hash; rows without a key are always new."""
    keyed, free = new.where(F.col(key).isNotNull()), new.where(F.col(key).isNull())
    at = F.struct(*([F.col(order)] if order else []), F.xxhash64(*new.columns))
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*new.columns), at).alias("__r")).select("__r.*")
    fresh = first if stored is None else first.join(stored.select(key), key, "left_anti")
    return fresh.select(*new.columns).unionByName(free)


def sink_idempotent_create(new: DataFrame, path: str, key: str, order: str | None = None, *, buckets: int = 16) -> KeyedTable:
    """Append rows with unknown keys; an existing key is a success, not an error.

    Of the table at ``path`` the files that may hold one of the keys, told by their Bloom filters, are read for their keys.
    """
    table = KeyedTable(new.sparkSession, path, key, new.schema, buckets)
    table.create(new, lambda rows, stored: create_only(rows, stored, key, order))
    return table


def sink_upsert_latest(new: DataFrame, source: str | None, target: str, key: str, order: str, *, buckets: int = 16) -> KeyedTable | None:
    """Stored and new rows, the latest per key.

    With ``source`` and ``target`` one folder, it is a bucketed table and only the buckets of the new keys are written anew.
    With two folders the second gets a whole copy.
    """
    if source == target:
        table = KeyedTable(new.sparkSession, target, key, new.schema, buckets)
        table.rewrite(new, lambda stored, rows: latest_by_key(stored, rows, key, order))
        return table
    stored = new.limit(0)
    if source is not None:
        kept = KeyedTable(new.sparkSession, source, key, new.schema, buckets)
        stored = kept.rows() if kept.exists() else new.sparkSession.read.parquet(source)
    latest_by_key(stored, new, key, order).write.mode("overwrite").parquet(target)
    return None


def sink_account_upsert(accounts: DataFrame | KeyedTable, new: DataFrame, target: str, key: str = "user_id", *, order: str) -> None:
    """Insert or update accounts: in the buckets of a keyed table that the new keys touch, or as a whole copy of ``accounts``."""
    if isinstance(accounts, KeyedTable):
        accounts.rewrite(new, lambda stored, rows: upsert(stored, rows, key, order))
    else:
        upsert(accounts, new, key, order).write.mode("overwrite").parquet(target)


def sink_account_insert(new: DataFrame, target: str) -> None:
    new.select(F.col("uuid").alias("id"), "email", "ai_service_id", "user_key").write.mode("append").parquet(target)


def prompt_log(decided: DataFrame, reason_chars: int | None = None) -> DataFrame:
    """Prompt log rows of decided requests; ``reason_chars`` cuts the reason to the width of a target's column."""
    reason = F.coalesce("reason", F.lit(""))
    return decided.select(
        F.lit(0).cast("short").alias("agent_id"), "prompt", F.col("at").alias("reg_date"), "session_id",
        F.lit("").alias("user_role"), F.when(F.col("action") == "block", 0).otherwise(1).cast("short").alias("allowed"),
        F.coalesce("masked_contents", F.lit("")).alias("modified_prompt"),
        (reason if reason_chars is None else F.substring(reason, 1, reason_chars)).alias("reason"))


def sink_prompt_log(decided: DataFrame, target: str) -> None:
    prompt_log(decided).write.mode("append").parquet(target)
