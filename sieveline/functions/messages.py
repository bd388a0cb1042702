"""Chat messages held as ``array<struct<role,content,parts>>`` inside a request row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions.text import blank_to_null, safe_get
from sieveline.schemas import MESSAGE, MESSAGES

_NO_PARTS = "array<struct<type:string,text:string>>"


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"),
                    F.lit(None).cast(_NO_PARTS).alias("parts")).cast(MESSAGE)


def message_text(m: Column) -> Column:
    """Content of a message; of a part list, the first part of type text."""
    part = F.try_element_at(F.filter(m["parts"], lambda p: p["type"] == "text"), F.lit(1))["text"]
    return F.coalesce(part, m["content"])


def _last_of(messages: Column, role: str) -> Column:
    return message_text(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1)))


def last_user_message(messages: Column) -> Column:
    return _last_of(messages, "user")


def last_assistant_message(messages: Column) -> Column:
    return _last_of(messages, "assistant")


def last_message(messages: Column) -> Column:
    return F.coalesce(message_text(F.try_element_at(messages, F.lit(-1))), F.lit(""))


def get_system_message(messages: Column) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(1))


def remove_system_messages(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def pop_system_message(messages: Column) -> Column:
    return F.struct(get_system_message(messages).alias("system"), remove_system_messages(messages).alias("rest"))


def upsert_system_message(messages: Column, content: Column) -> Column:
    """A leading system message gets the text put in front of its own; otherwise one is put in front."""
    head = F.try_element_at(messages, F.lit(1))
    joined = F.concat(content, F.lit("\n"), head["content"])
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(head["role"] == "system", F.concat(F.array(message("system", joined)), rest)).otherwise(
        F.concat(F.array(message("system", content)), messages))


def ensure_language_prompt(messages: Column, needed: Column, prompt: str = C.LANGUAGE_PROMPT,
                           marker: str = C.LANGUAGE_MARKER) -> Column:
    """Put the language instruction in front unless a system message already carries the marker word."""
    told = F.exists(messages, lambda m: (m["role"] == "system") & F.coalesce(F.contains(m["content"], F.lit(marker)), F.lit(False)))
    return F.when(needed & ~told, F.concat(F.array(message("system", F.lit(prompt))), messages)).otherwise(messages)


def replace_last_content(messages: Column, content: Column) -> Column:
    last = F.try_element_at(messages, F.lit(-1))
    head = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(F.size(messages) > 0, F.concat(head, F.array(message(last["role"], content)))).otherwise(messages)


def to_body(session_id: Column, message_id: Column, prompt: Column, attachments: Column | None = None) -> Column:
    """Request body: metadata, one user message, attached files."""
    fields = [
        F.struct(session_id.alias("session_id"), message_id.alias("message_id")).alias("metadata"),
        F.array(message("user", prompt)).cast(MESSAGES).alias("messages")]
    if attachments is not None:
        fields.append(F.transform(attachments, lambda a: F.struct(
            a["id"].alias("id"), a["size"].alias("size"), a["name"].alias("name"),
            a["mime_type"].alias("mime_type"))).alias("attach_file"))
    return F.struct(*fields)


def to_output_body(session_id: Column, message_id: Column, output: Column) -> Column:
    return to_body(session_id, message_id, output)


def project_identity(user: Column) -> list[Column]:
    """The five identity columns of a ``struct<name,email,ai_service,uuid,client_host>`` with their defaults."""
    empty = F.lit("")
    return [F.coalesce(user["name"], empty).alias("user_id"), F.coalesce(user["email"], empty).alias("email"),
            F.coalesce(user["ai_service"], F.lit(0)).alias("ai_service"), F.coalesce(user["uuid"], empty).alias("uuid"),
            F.coalesce(user["client_host"], empty).alias("client_host")]


# --- bodies of unknown shape, parsed as VARIANT ----------------------------------------------------------------------

def _text_at(body: Column, path: str) -> Column:
    """Non-empty JSON string at a path; numbers and objects do not count."""
    is_text = F.schema_of_variant(F.try_variant_get(body, path, "variant")) == "STRING"
    return F.when(is_text, blank_to_null(safe_get(body, path)))


def extract_response_text(body: Column) -> Column:
    """Answer text wherever a model API puts it: messages, choices, then the common single keys."""
    messages = F.try_variant_get(body, "$.messages", "array<variant>")
    answers = F.filter(messages, lambda m: (
        safe_get(m, "$.role").isin("assistant", "model") & _text_at(m, "$.content").isNotNull()))
    candidates = [_text_at(F.try_element_at(answers, F.lit(-1)), "$.content"),
                  _text_at(body, "$.choices[0].message.content"), _text_at(body, "$.choices[0].text")]
    for key in ("response", "output", "result", "assistant"):
        candidates += [_text_at(body, f"$.{key}"), _text_at(body, f"$.{key}.content")]
    return F.coalesce(*candidates)


# Where a session id may be, in order of trust
SESSION_PATHS = ("$.metadata.__sid", "$.metadata.session_id", "$.metadata.conversation_id", "$.metadata.thread_id",
                 "$.metadata.chat_id", "$.session.id", "$.conversation.id", "$.session_id", "$._filters.inlet.__sid",
                 "$._filters.__sid")
CLIENT_IP_PATHS = ("$.client_ip", "$.src_ip", "$.ip", "$.request.ip")


def resolve_channel(body: Column) -> Column:
    return F.coalesce(blank_to_null(safe_get(body, "$.metadata.channel")), blank_to_null(safe_get(body, "$.channel")), F.lit("web"))


def resolve_session_id(body: Column, user_id: Column, day: Column) -> Column:
    """``struct<session_id,is_fallback>``; without any id a stable one is made of user, channel and day (yyyymmdd)."""
    found = F.coalesce(*[blank_to_null(safe_get(body, p)) for p in SESSION_PATHS])
    seed = F.concat_ws(":", F.coalesce(blank_to_null(user_id), F.lit("anon")), resolve_channel(body), day)
    made = F.concat(F.lit("ps-"), F.substring(F.sha1(seed), 1, 16))
    return F.struct(F.coalesce(found, made).alias("session_id"), found.isNull().alias("is_fallback"))


def resolve_client_ip(metadata: Column) -> Column:
    return F.coalesce(*[blank_to_null(safe_get(metadata, p)) for p in CLIENT_IP_PATHS])
