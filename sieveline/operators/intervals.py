"""Interval union over a long span table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A window never sees more rows than this many distinct starts, nor more buckets than 2^31 / BUCKET per key.
BUCKET = 65_536


def merge_islands(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", *,
                  bucket: int = BUCKET) -> DataFrame:
    """Union of overlapping or touching intervals per key.

    The textbook running-maximum window puts a whole key into one task. Here a key is cut into buckets of starts: equal
    starts are first reduced to their longest interval, so a bucket holds at most ``bucket`` rows however many spans
    there are; per bucket only its reach and its last island start travel on, at most 2^31/bucket rows per key.
    """
    s, e, b = F.col(start), F.col(end), F.col("__bucket")
    longest = spans.groupBy(*keys, s).agg(F.max(e).alias(end)).withColumn("__bucket", F.floor(s / bucket))
    carry_w = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    reach = (longest.groupBy(*keys, b).agg(F.max(e).alias("__reach"))
             .select(*keys, "__bucket", F.max("__reach").over(carry_w).alias("__carry")))
    in_bucket = W.partitionBy(*keys, "__bucket").orderBy(start)
    before = in_bucket.rowsBetween(W.unboundedPreceding, -1)
    upto = in_bucket.rowsBetween(W.unboundedPreceding, 0)
    running = F.greatest(F.max(e).over(before), F.col("__carry"))
    marked = (longest.join(reach, [*keys, "__bucket"])
              .withColumn("__opens", F.when(running.isNull() | (s > running), s))
              .withColumn("__island", F.max("__opens").over(upto)))
    last_open = (marked.groupBy(*keys, b).agg(F.max("__opens").alias("__last"))
                 .select(*keys, "__bucket", F.max("__last").over(carry_w).alias("__before")))
    return (marked.join(last_open, [*keys, "__bucket"])
            .withColumn("__island", F.coalesce("__island", "__before"))
            .groupBy(*keys, F.col("__island").alias(start)).agg(F.max(e).alias(end)))
