"""The same operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sieveline.functions.text import user_key
from sieveline.operators.accounts import account_uuid
from sieveline.operators.policy import policy_diff
from sieveline.sources.sinks import RECORDS_PER_FILE, stored_table
from sieveline.streaming.keyed import SALTS, first_of_key, known_of_key, start_keyed

Op = Callable[[DataFrame], DataFrame]


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def _trigger(writer, every: str | None):
    """Fixed interval, or everything available now and stop."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def _write_once(batch: DataFrame, path: str, batch_id: int) -> None:
    """A batch owns one folder; when Spark replays the batch the folder is replaced, not doubled."""
    batch.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).parquet(f"{path}/batch_id={batch_id}")


def stream_filter(stream: DataFrame, filters: Sequence[Op], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Continuous filtering: the batch operators applied to a stream of requests."""
    out = stream
    for f in filters:
        out = out.transform(f)
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer.outputMode("append"), every).start()


def stream_audit_sink(stream: DataFrame, base: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Audit documents ``(index, date, doc)`` to JSON lines every few seconds, exactly once per document."""
    flat = stream.select("index", "date", F.to_json("doc").alias("value"))
    writer = (flat.writeStream.format("text").partitionBy("index", "date").option("path", base)
              .option("maxRecordsPerFile", RECORDS_PER_FILE).option("checkpointLocation", checkpoint))
    return _trigger(writer.outputMode("append"), every).start()


def stream_policy_refresh(stream: DataFrame, read_policy: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame],
                          path: str, checkpoint: str, every: str | None = "60 seconds",
                          on_change: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Each batch is judged by the policy as it is now; the policy is swapped only when it really changed.

    ``apply`` gets the batch and the scope map. ``on_change`` gets the differences.
    """
    # The policy source changes under us. Which written copy judges a batch is noted in the checkpoint folder before the
    # batch is judged, so a restart goes on from there and a replayed batch meets the policy it met before.
    notes = f"{checkpoint}/policy_of_batch"

    def noted(spark: SparkSession, upto: int) -> tuple[int, str] | None:
        known = stored_table(spark, notes)
        row = None if known is None else known.where(F.col("batch") <= upto).orderBy(F.desc("batch")).first()
        return row and (row["batch"], row["at"])

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = noted(spark, batch_id)
        if last is None or last[0] < batch_id:
            fresh, at = read_policy(), last and last[1]
            changes = policy_diff(spark.read.parquet(at), fresh) if at else None
            if changes is None or not changes.isEmpty():
                if changes is not None and on_change:
                    on_change(changes)
                at = f"{checkpoint}/policy/{batch_id}"
                fresh.write.mode("overwrite").parquet(at)
            spark.createDataFrame([(batch_id, at)], "batch bigint, at string").coalesce(1).write.mode("append").parquet(notes)
            last = batch_id, at
        _write_once(apply(batch, spark.read.parquet(last[1])), path, batch_id)

    return _trigger(stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint), every).start()


def stream_account_dedup(stream: DataFrame, target: str, checkpoint: str, every: str | None = "10 seconds", *,
                         stored: DataFrame | None = None) -> StreamingQuery:
    """Accounts seen for the first time, appended with their id. ``stored`` is a stream of accounts known from elsewhere."""
    seen = stream.select(user_key(F.col("email"), F.col("ai_service")).alias("user_key"), "email", F.col("ai_service").alias("ai_service_id"))
    fresh = first_of_key(seen.where(F.col("user_key").isNotNull()), "user_key", "email", stored)
    writer = fresh.withColumn("uuid", account_uuid(F.col("user_key"))).writeStream.format("parquet").option("path", target)
    return start_keyed(_trigger(writer.option("checkpointLocation", checkpoint).outputMode("append"), every), stream.sparkSession)


def stream_uuid_assign(stream: DataFrame, stored: DataFrame, path: str, checkpoint: str, every: str | None = None, *,
                       salts: int = SALTS) -> StreamingQuery:
    """Requests with the id of their account: the stored one, else the stable id of the key.

    ``stored`` (``user_key, id``) is a stream too: accounts that others store while this runs are known from the next batch on.
    Several ids stored for a key in one batch: the smallest; later ones don't replace it.
    """
    out = known_of_key(stream, "user_key", stored.select("user_key", F.col("id").alias("__known")), salts)
    assigned = out.withColumn("uuid", F.coalesce("__known", account_uuid(F.col("user_key")))).drop("__known")
    writer = assigned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return start_keyed(_trigger(writer.outputMode("append"), every), stream.sparkSession)


def stream_idempotent(stream: DataFrame, key: str, path: str, checkpoint: str, *, order: str | None = None,
                      every: str | None = None, stored: DataFrame | None = None) -> StreamingQuery:
    """Requests whose id was not seen yet, the first per id by ``order`` and then by hash; rows without an id are all kept.

    An id is known for good, however long ago it came. ``stored`` is a stream of rows with ids known from elsewhere.
    """
    fresh = first_of_key(stream.where(F.col(key).isNotNull()), key, order, stored).unionByName(stream.where(F.col(key).isNull()))
    writer = fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return start_keyed(_trigger(writer.outputMode("append"), every), stream.sparkSession)
