"""State by key: what a stream has seen of a key, looked up without reading anything else that is stored.

The state lives in Spark's state store, which keeps it in RocksDB on the executors and its changes in the checkpoint folder:
a batch reads the keys it brings and no others, files are merged level by level by the store itself, and a restarted or
replayed batch begins from the state that belongs to it. Stored tables are streams as well: their rows are put into the
state and yield nothing, so rows that others add while the query runs are known from the next batch on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Copies of the stored rows over which requests are dealt, so that one key's requests are not all one task's.
SALTS = 4
#: Groups over which the keys of ``known_of_key`` are dealt; a checkpoint belongs to this number.
BUCKETS = 1024
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start_keyed(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a query with its state in RocksDB, whatever the session says; the session's settings stay as they are."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _least_in_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key by ``__at`` in every batch of a task: a hot key sends a row per batch, not all its rows."""
    for batch in batches:
        if batch.num_rows > 1:
            order = pc.sort_indices(batch.select(["__key", "__stored", "__at0", "__at1"]), sort_keys=[
                ("__key", "ascending"), ("__stored", "descending"), ("__at0", "ascending"), ("__at1", "ascending")], null_placement="at_start")
            keys = batch.column("__key").take(order)
            first = pa.concat_arrays([pa.array([True]), pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))])
            batch = batch.take(order.filter(first))
        yield batch


def _ordered(rows: DataFrame, key: str, order: str | None, stored: bool) -> DataFrame:
    """``__key, __stored, __at0, __at1, __row``: the order of rows as columns that any type gives; the row as a whole."""
    whole = F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
    at = F.col(order) if order else F.lit(0)
    return rows.select(F.col(key).cast("string").alias("__key"), F.lit(stored).alias("__stored"), at.alias("__at0"), F.xxhash64(whole).alias("__at1"),
                       whole.alias("__row"))


def first_of_key(stream: DataFrame, key: str, order: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """The first row of each key that no earlier batch and no row of ``stored`` had; of one batch's rows the least by
    ``order`` (null first), then by hash. Keys are not null. Rows go through state as JSON text and come back in their types.
    """
    rows = _ordered(stream, key, order, False)
    if stored is not None:
        known = stored.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("__key"))
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[2:]}
        rows = rows.unionByName(known.select("__key", F.lit(True).alias("__stored"), none["__at0"], F.lit(0).cast("bigint").alias("__at1"), none["__row"]))
    slim = rows.mapInArrow(_least_in_batch, rows.schema)

    def first(_: tuple, batches: Iterable[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        least: pd.DataFrame | None = None
        for rows in batches:
            least = rows if least is None else pd.concat([least, rows])
            least = least.sort_values(["__stored", "__at0", "__at1"], ascending=[False, True, True], na_position="first").head(1)
        state.update((True,))
        if not least["__stored"].iloc[0]:
            yield least[["__row"]]

    found = slim.groupBy("__key").applyInPandasWithState(first, "__row string", "seen boolean", "append", "NoTimeout")
    parsed = F.from_json("__row", stream.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return found.select(parsed.alias("__r")).select("__r.*")


class _Known(StatefulProcessor):
    """The known value of every key of a bucket, as a map of which a batch reads and writes only the keys it brings."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # The batch's rows of this bucket and salt; stored values may come behind requests.
        told: dict[str, str] = {}
        held: list[pd.DataFrame] = []
        # Spark makes these frames from named tuples, whose fields cannot begin with an underscore.
        for batch in rows:
            asks = batch["row"].notna()
            for k, v in zip(batch["key"][~asks], batch["value"][~asks]):
                told[k] = min(told.get(k, v), v)
            held.append(batch.loc[asks, ["key", "row"]])
        answers: dict[str, str | None] = {}
        # Each look into the state is a message; a bucket that knows no key yet needs none.
        begun = self.known.exists()

        def known(k: str) -> str | None:
            had = self.known.getValue((k,)) if begun else None
            return None if had is None else had[0]

        for k, v in told.items():
            answers[k] = known(k)
            if answers[k] is None:
                self.known.updateValue((k,), (v,))
                answers[k] = v
        for asked in held:
            for k in asked["key"].unique():
                if k not in answers:
                    answers[k] = known(k)
            if len(asked):
                yield pd.DataFrame({"__row": asked["row"], "__known": [answers[k] for k in asked["key"]]})

    def close(self) -> None:
        pass


def known_of_key(stream: DataFrame, key: str, stored: DataFrame, salts: int = SALTS) -> DataFrame:
    """All rows of the stream with ``__known``: the value that ``stored`` (``key, __known``) has for the key by then, else null.

    Each stored row is put into ``salts`` states and a request asks one of them, dealt by its hash: a key with a third of all
    requests is that many tasks' work. Keys are dealt over ``BUCKETS`` groups, so Python is called once per bucket and not once per
    key; a task holds the batch's rows of one bucket and salt.
    """
    columns = stream.columns
    whole = F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    text = F.col(key).cast("string")
    bucket = F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket")
    asked = stream.where(F.col(key).isNotNull()).select(bucket, F.pmod(F.xxhash64(whole), F.lit(salts)).cast("int").alias("salt"), text.alias("key"),
                                                        none.alias("value"), whole.alias("row"))
    told = stored.where(F.col(key).isNotNull() & F.col("__known").isNotNull()).select(
        bucket, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), text.alias("key"), F.col("__known").cast("string").alias("value"), none.alias("row"))
    found = asked.unionByName(told).groupBy("bucket", "salt").transformWithStateInPandas(
        _Known(), "__row string, __known string", "append", "None")
    parsed = F.from_json("__row", stream.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    kind = stored.schema["__known"].dataType
    answered = found.select(parsed.alias("__r"), F.col("__known").cast(kind).alias("__known")).select("__r.*", "__known")
    return answered.unionByName(stream.where(F.col(key).isNull()).withColumn("__known", F.lit(None).cast(kind)))
