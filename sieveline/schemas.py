"""Row types of requests, responses, messages, rules and verdicts."""

from __future__ import annotations

from pyspark.sql import types as T

ATTACHMENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("mime_type", T.StringType())])

PROMPTS = T.StructType([
    T.StructField("filter_list", T.ArrayType(T.StringType())), T.StructField("prompt", T.StringType()),
    T.StructField("encoding", T.BooleanType()), T.StructField("user_id", T.StringType()),
    T.StructField("email", T.StringType()), T.StructField("ai_service", T.IntegerType()),
    T.StructField("client_host", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("message_id", T.StringType()), T.StructField("attachments", T.ArrayType(ATTACHMENT))])

OUTPUTS = T.StructType([
    T.StructField("llm_output", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("email", T.StringType()), T.StructField("ai_service", T.IntegerType()),
    T.StructField("client_host", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("message_id", T.StringType())])

MESSAGE = "struct<role:string,content:string,parts:array<struct<type:string,text:string>>>"
MESSAGES = f"array<{MESSAGE}>"
VERDICT = ("struct<ord:int,filter_id:string,action:string,action_code:int,masked_contents:string,"
           "block_message:string>")
VERDICTS = f"array<{VERDICT}>"

RULE_EXPORT = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StringType())), T.StructField("typeMask", T.IntegerType()),
    T.StructField("operator", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("scope", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("adminId", T.StringType())])))])

PROMPT_LOG = T.StructType([
    T.StructField("agent_id", T.ShortType()), T.StructField("prompt", T.StringType()),
    T.StructField("reg_date", T.TimestampType()), T.StructField("session_id", T.StringType()),
    T.StructField("user_role", T.StringType()), T.StructField("allowed", T.ShortType()),
    T.StructField("modified_prompt", T.StringType()), T.StructField("reason", T.StringType())])

LOG_BATCH = T.StructType([
    T.StructField("index", T.StringType()), T.StructField("log_list", T.ArrayType(T.VariantType()))])
