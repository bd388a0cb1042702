"""Queries that go through files: written sinks, JSON requests, and streams run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.plans import inputs as I
from sieveline.plans.registry import Tables, query
from sieveline.sources import readers, sinks
from sieveline.streaming import jobs


def _stream(t: Tables, table: str) -> DataFrame:
    # A table is one file or a folder of files. A stream takes a plain path for a folder; as a glob it may be either.
    return t.spark.readStream.schema(t.read(table).schema).parquet(f"{t.dir}/{table}.parque[t]")


def _accounts(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("user"), (F.col("user_id") * 7).cast("string"), F.lit("@example.com")).alias("email"), (F.col("user_id") % 5).cast("int").alias("ai_service"), "event_id", "ts")


@query("""SELECT 'm-' || doc_id AS message_id, md5(text) AS digest, doc_id % 2 = 0 AS encoding, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id % 6)::INT END AS ai_service, '' AS email, 'input_filter,secret_filter,slm_filter' AS filters FROM documents""")
def scan_prompts(t: Tables) -> DataFrame:
    path = t.work("requests")
    # Fields that are null are left out of the JSON, as a client would leave them out.
    t.documents.select(F.concat(F.lit("m-"), F.col("doc_id").cast("string")).alias("message_id"), F.col("text").alias("prompt"), F.when(F.col("doc_id") % 2 == 0, True).alias("encoding"),
                       F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 6).alias("ai_service")).write.json(path)
    return readers.scan_prompts(t.spark, path).select("message_id", F.md5("prompt").alias("digest"), "encoding", "ai_service", "email", F.array_join("filter_list", ",").alias("filters"))


@query("SELECT 'm-' || event_id AS id, 'input_filter' AS index, strftime(ts, '%Y-%m-%d') AS date FROM events")
def sink_audit_jsonl(t: Tables) -> DataFrame:
    path = t.work("audit-log")
    docs = t.events.select(F.lit("input_filter").alias("index"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.struct(F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("id")).alias("doc"))
    sinks.sink_audit_jsonl(docs, path)
    lines = t.spark.read.schema("value string, index string, date string").text(path)
    return lines.select(F.get_json_object("value", "$.id").alias("id"), "index", "date")


@query(f"WITH {I.PROBED} SELECT doc_id, regexp_matches(text, 'AKIA[0-9]') AS secret, md5(text) AS digest FROM probed")
def stream_filter(t: Tables) -> DataFrame:
    work = t.work("filter")
    filters = [lambda d: d.withColumn("text", F.expr(f"text || {I.PROBE}")), lambda d: d.withColumn("secret", F.col("text").rlike("AKIA[0-9]")),
               lambda d: d.select("doc_id", "secret", F.md5("text").alias("digest"))]
    jobs.stream_filter(_stream(t, "documents").select("doc_id", "text"), filters, f"{work}/out", f"{work}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{work}/out")


@query("SELECT 'input_filter' AS index, event_type, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY ALL")
def stream_audit_sink(t: Tables) -> DataFrame:
    work = t.work("audit")
    docs = _stream(t, "events").select(F.lit("input_filter").alias("index"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.struct("event_id", "event_type").alias("doc"))
    jobs.stream_audit_sink(docs, f"{work}/out", f"{work}/ckpt", every=None).awaitTermination()
    lines = t.spark.read.schema("value string, index string, date string").text(f"{work}/out")
    return lines.groupBy("index", F.get_json_object("value", "$.event_type").alias("event_type"), "date").agg(F.count(F.lit(1)).alias("n"))


# The policy binds parts to users; it's read afresh for each batch, and the batches see three states of it in turn.
_STATES = "CASE day % 3 WHEN 0 THEN p_partkey % 3 = 0 WHEN 1 THEN p_partkey % 3 < 2 ELSE p_partkey % 3 > 0 END"


@query(f"""WITH e AS (SELECT event_id, user_id % 50 AS who, event_id % 3 AS day FROM events)
  SELECT event_id, p_partkey AS rule FROM e JOIN part ON p_partkey = who + 1 WHERE {_STATES}""")
def stream_policy_refresh(t: Tables) -> DataFrame:
    work = t.work("policy")
    events = t.events.select("event_id", (F.col("user_id") % 50).alias("who"), (F.col("event_id") % 3).alias("day"))

    def policy(day: int) -> DataFrame:
        listed = t.part.select("p_partkey", F.lit(day).alias("day")).where(F.expr(_STATES))
        return listed.select(F.lit("f").alias("filter_id"), F.lit("default").alias("scope"), F.col("p_partkey").cast("string").alias("id"), F.lit("block").alias("action"), F.lit("x").alias("rule"))

    def apply(batch: DataFrame, rules: DataFrame) -> DataFrame:
        return batch.join(rules.select(F.col("id").cast("bigint").alias("rule")), F.col("who") + 1 == F.col("rule")).select("event_id", "rule")

    # Three runs of one stream, each with the next day's events: the second and third go on from the checkpoint.
    for day in range(3):
        events.where(F.col("day") == day).write.mode("append").parquet(f"{work}/in")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{work}/in")
        jobs.stream_policy_refresh(stream, lambda day=day: policy(day), apply, f"{work}/out", f"{work}/ckpt", every=None).awaitTermination()
    return t.spark.read.parquet(f"{work}/out").select("event_id", "rule")


_KEYS = "SELECT DISTINCT 'user' || (user_id * 7) || '@example.com_' || (user_id % 5) AS user_key FROM events"


@query(_KEYS)
def stream_account_dedup(t: Tables) -> DataFrame:
    work = t.work("accounts")
    jobs.stream_account_dedup(_accounts(_stream(t, "events")), f"{work}/out", f"{work}/ckpt", every=None).awaitTermination()
    return t.spark.read.parquet(f"{work}/out").select("user_key")


@query(f"""WITH e AS (SELECT event_id, 'user' || (user_id * 7) || '@example.com_' || (user_id % 5) AS user_key FROM events), s AS (SELECT 'user' || c_custkey || '@example.com_' || (c_nationkey % 5) AS user_key, 'u' || c_custkey AS id FROM customer),
  u AS (SELECT event_id, id, sha256(user_key) AS h FROM e LEFT JOIN s USING (user_key))
  SELECT event_id, coalesce(id, left(h, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS uuid FROM u""")
def stream_uuid_assign(t: Tables) -> DataFrame:
    work = t.work("uuid")
    stored = readers.scan_users(_stream(t, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                                                              (F.col("c_nationkey") % 5).cast("int").alias("ai_service_id")))
    keyed = _accounts(_stream(t, "events")).withColumn("user_key", F.concat_ws("_", "email", F.col("ai_service").cast("string")))
    jobs.stream_uuid_assign(keyed.select("event_id", "user_key"), stored.select("user_key", "id"), f"{work}/out", f"{work}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{work}/out").select("event_id", "uuid")


@query("SELECT DISTINCT 'm-' || (event_id % 7000) AS message_id FROM events")
def stream_idempotent(t: Tables) -> DataFrame:
    work = t.work("once")
    rows = _stream(t, "events").select(F.concat(F.lit("m-"), (F.col("event_id") % 7000).cast("string")).alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.stream_idempotent(rows, "message_id", f"{work}/out", f"{work}/ckpt", order="ts").awaitTermination()
    return t.spark.read.parquet(f"{work}/out").select("message_id")


