"""Audit documents as nested structs, one shape per index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import text as X


def _id(c: Column) -> Column:
    return F.struct(c.alias("id"))


def _user(user_id: Column, email: Column, uuid: Column, role: Column | None = None) -> Column:
    fields = [user_id.alias("id")] + ([role.alias("role")] if role is not None else [])
    return F.struct(*fields, email.alias("email"), uuid.alias("uuid"))


def audit_input_doc(*, at: Column, message_id: Column, session_id: Column, user_id: Column, email: Column, uuid: Column,
                    client_host: Column, ai_service: Column, text: Column, channel: Column | None = None,
                    role: Column | None = None) -> Column:
    return F.struct(
        X.iso_utc(at).alias("@timestamp"), F.struct(message_id.alias("id"), F.lit("query").alias("type")).alias("event"),
        _id(message_id).alias("request"), _id(session_id).alias("session"),
        _user(user_id, email, uuid, F.lit("") if role is None else role).alias("user"),
        F.struct(client_host.alias("ip")).alias("src"), (F.lit("web") if channel is None else channel).alias("channel"),
        X.service_name(ai_service).alias("ai_service"), F.struct(text.alias("text")).alias("query"))


def audit_detect_doc(*, at: Column, stage: str, message_id: Column, session_id: Column, user_id: Column, email: Column,
                     uuid: Column, client_host: Column, ai_service: Column, action: Column, types: Column, samples: Column,
                     content: Column, masked: Column, policy_id: Column | None = None, policy_name: Column | None = None) -> Column:
    """Detection document; callers pass content already masked or hashed, as raw text would put secrets into the log."""
    hit = types.isNotNull()
    return F.struct(
        X.iso_utc(at).alias("@timestamp"), F.lit(stage).alias("filter"), F.lit(stage).alias("filter_name"),
        F.struct(message_id.alias("id"), F.lit("detect").alias("type")).alias("event"), content.alias("content"),
        _id(message_id).alias("request"), _id(session_id).alias("session"), _user(user_id, email, uuid).alias("user"),
        F.array(F.lit(stage)).alias("stage"), F.when(hit, "hit").otherwise("pass").alias("detection"),
        (action == "block").alias("should_block"), action.alias("mode"),
        F.coalesce(policy_id if policy_id is not None else F.lit(None), F.lit("")).alias("policy_id"),
        F.coalesce(policy_name if policy_name is not None else F.lit(None), F.lit("")).alias("policy_name"),
        F.struct(client_host.alias("ip")).alias("src"),
        F.when(hit, F.struct(types.alias("types"), samples.alias("samples"), F.lit(1.0).alias("confidence"))).alias("pii"),
        X.service_name(ai_service).alias("ai_service"), masked.alias("masked_contents"))


def audit_output_doc(*, at: Column, message_id: Column, session_id: Column, response: Column, response_id: Column,
                     user_id: Column, email: Column, uuid: Column, client_host: Column, ai_service: Column, model: Column,
                     latency_ms: Column, prompt_tokens: Column, completion_tokens: Column, total_tokens: Column,
                     filters: Column, is_fallback: Column | None = None, hash_only: bool = False, store_text: bool = True,
                     max_bytes: int = 200_000) -> Column:
    stored = X.apply_storage_policy(response, hash_only=hash_only, store_text=store_text, max_bytes=max_bytes)
    fallback = F.lit(False) if is_fallback is None else is_fallback
    return F.struct(
        X.iso_utc(at).alias("@timestamp"),
        F.struct(F.coalesce(X.blank_to_null(response_id), message_id).alias("id"), F.lit("response").alias("type")).alias("event"),
        _id(message_id).alias("request"),
        F.struct(
            response_id.alias("id"), stored["text"].alias("text"), stored["text_truncated_bytes"].alias("text_truncated_bytes"),
            stored["hash_sha256"].alias("hash_sha256"), model.alias("model"), latency_ms.alias("latency_ms"),
            F.struct(prompt_tokens.alias("prompt"), completion_tokens.alias("completion"),
                     total_tokens.alias("total")).alias("tokens")).alias("response"),
        F.struct(session_id.alias("id"), (~fallback).alias("present")).alias("session"),
        _user(user_id, email, uuid, F.lit("")).alias("user"), F.struct(client_host.alias("ip")).alias("src"),
        F.lit("web").alias("channel"), X.service_name(ai_service).alias("ai_service"), filters.alias("filters"))
