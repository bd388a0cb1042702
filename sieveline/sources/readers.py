"""Reading requests, conversations, policies, files and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions.text import user_key
from sieveline.operators.rules import quarantine_rules
from sieveline.schemas import LOG_BATCH, MESSAGE, OUTPUTS, PROMPTS, RULE_EXPORT


def _with_defaults(df: DataFrame) -> DataFrame:
    empty = F.lit("")
    defaults: dict[str, Column] = {
        "filter_list": F.array(*[F.lit(f) for f in C.DEFAULT_FILTERS]), "encoding": F.lit(False), "ai_service": F.lit(0),
        "attachments": F.array().cast("array<struct<id:string,size:bigint,name:string,mime_type:string>>")}
    return df.select(*[F.coalesce(F.col(c), defaults.get(c, empty)).alias(c) for c in df.columns])


def scan_prompts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Typed scan of filter requests; absent fields get the defaults of the request form."""
    return _with_defaults(spark.read.schema(PROMPTS).format(fmt).load(path))


def scan_outputs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _with_defaults(spark.read.schema(OUTPUTS).format(fmt).load(path))


def scan_conversations(long: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row ``(key, messages)`` per conversation, its messages in turn order.

    The array is as large as the conversation: that is what this form is for. Lookups and edits of stored turns that need no
    array are in ``operators.turns``.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))))
    parts = F.lit(None).cast("array<struct<type:string,text:string>>")
    return long.groupBy(key).agg(packed.alias("__m")).select(key, F.transform("__m", lambda m: F.struct(
        m["r"].alias("role"), m["x"].alias("content"), parts.alias("parts")).cast(MESSAGE)).alias("messages"))


def latest_turn(long: DataFrame, role: str | None = None, *, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Last turn (of a role) per conversation, by partial aggregation instead of a window over the conversation."""
    rows = long if role is None else long.where(F.col("role") == role)
    last = F.max_by(F.struct(turn, "role", "text"), F.col(turn))
    return rows.groupBy(key).agg(last.alias("__m")).select(key, "__m.*")


def recent_history(long: DataFrame, n: int = 4, *, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Last ``n`` turns per conversation, newest first; each task forwards at most ``n`` rows per conversation."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.desc(turn))
    return long.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def reject_invalid_prompt(requests: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(requests with a user text, the others)."""
    ok = F.coalesce(F.col(text), F.lit("")) != ""
    return requests.where(ok), requests.where(~ok)


# --- policies --------------------------------------------------------------------------------------------------------


def scan_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """Rule export: deployed rules with a usable pattern, in file order."""
    raw = spark.read.schema(RULE_EXPORT).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("data").alias("ord", "r")).select("ord", "r.*")
    name = F.trim(F.coalesce("name", F.lit("")))
    rules = (rows.where(F.lower("status") == "deployed")
             .withColumn("name", F.when(name == "", "UNNAMED").otherwise(name)).withColumn("regex_flag", F.lit(0)))
    good, _ = quarantine_rules(rules)
    return good.withColumn("type", F.lower("name")).withColumn("token", F.concat(F.lit("["), "name", F.lit("]")))


def deployed_rules(table: DataFrame) -> DataFrame:
    """Deployed rules of the policy table; the filter is pushed into whatever source the table comes from."""
    return table.where(F.col("status") == "deployed").select(
        "id", "name", "targets", "type_mask", "operator", "rule", "regex_flag", "regex_group", "regex_group_val", "action",
        "status")


def scan_rules_db(spark: SparkSession, url: str, table: str = "policy_rules", **options: str) -> DataFrame:
    """Deployed rules over JDBC."""
    return deployed_rules(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def scan_rule_bindings(table: DataFrame, filter_id: str | None = None) -> DataFrame:
    rows = table if filter_id is None else table.where(F.col("filter_id") == filter_id)
    return rows.select("id", "filter_id", "scope", "policy_rule_id", "subject_id")


def scan_users(table: DataFrame, where: Column | str | None = None) -> DataFrame:
    rows = table if where is None else table.where(where)
    return rows.withColumn("user_key", user_key(F.col("email"), F.col("ai_service_id")))


def scan_settings_pivot(table: DataFrame, category: str = "file-control") -> DataFrame:
    """One row ``(allow_ext array<string>, max_size int)`` of the key/value settings of a category."""
    def value(key: str) -> Column:
        return F.max(F.when(F.col("skey") == key, F.col("svalue")))

    return table.where(F.col("category") == category).agg(
        F.split(value("fileControlAllowedExtensions"), ",").alias("allow_ext"),
        value("fileControlMaxSize").cast("int").alias("max_size"))


# --- files and logs --------------------------------------------------------------------------------------------------


def scan_attachments(spark: SparkSession, path: str, max_size: int | None = None, glob: str | None = None) -> DataFrame:
    """(path, length, content); a size limit is pushed into the file source, which then skips reading larger files."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length", "content")
    return files if max_size is None else files.where(F.col("length") <= max_size)


def scan_prompt_log(table: DataFrame, where: Column | str | None = None, limit: int | None = None) -> DataFrame:
    rows = table if where is None else table.where(where)
    return rows if limit is None else rows.limit(limit)


def limit_log(table: DataFrame, n: int) -> DataFrame:
    return table.limit(n)


def scan_log_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_BATCH).json(path)


def ingest_log_batch(batches: DataFrame, known: Sequence[str] = C.AUDIT_INDEXES) -> DataFrame:
    """One row per log of the batches, with the index it is routed to; unknown indexes are kept and marked."""
    return batches.select("index", F.explode("log_list").alias("log")).withColumn("known", F.col("index").isin(*known))
