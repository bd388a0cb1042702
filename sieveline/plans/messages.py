"""Message, body and scalar text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import messages as M
from sieveline.functions import text as X
from sieveline.operators import turns
from sieveline.plans import inputs as I
from sieveline.plans.registry import Tables, query
from sieveline.sources import readers


def _per_conversation(t: Tables, *aggregates: Column) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(*aggregates)


@query("""SELECT conv_id, count(*)::INT AS n, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, '|' ORDER BY turn)) AS digest
  FROM conversations GROUP BY conv_id""")
def scan_conversations(t: Tables) -> DataFrame:
    rows = readers.scan_conversations(t.conversations)
    return rows.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                       F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("digest"))


def _last_sql(role: str) -> str:
    return f"""SELECT conv_id, md5(max_by(text, turn) FILTER (role = '{role}')) AS digest FROM conversations GROUP BY conv_id"""


@query(_last_sql("user"))
def last_user_message(t: Tables) -> DataFrame:
    return _per_conversation(t, F.md5(turns.last_text("user")).alias("digest"))


@query(_last_sql("assistant"))
def last_assistant_message(t: Tables) -> DataFrame:
    return _per_conversation(t, F.md5(turns.last_text("assistant")).alias("digest"))


@query("SELECT conv_id, md5(max_by(text, turn)) AS digest FROM conversations GROUP BY conv_id")
def last_message(t: Tables) -> DataFrame:
    return _per_conversation(t, F.md5(turns.last_text()).alias("digest"))


@query("SELECT conv_id, md5(min_by(text, turn) FILTER (role = 'system')) AS digest FROM conversations GROUP BY conv_id")
def get_system_message(t: Tables) -> DataFrame:
    return _per_conversation(t, F.md5(turns.system_text()).alias("digest"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role <> 'system'")
def remove_system_messages(t: Tables) -> DataFrame:
    return turns.without_system(t.conversations).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("""SELECT conv_id, md5(min_by(text, turn) FILTER (role = 'system')) AS system_digest, (count(*) FILTER (role <> 'system'))::BIGINT AS n_rest FROM conversations GROUP BY conv_id""")
def pop_system_message(t: Tables) -> DataFrame:
    return turns.pop_system(t.conversations).select("conv_id", F.md5("system").alias("system_digest"), "n_rest")


@query("""WITH h AS (SELECT *, first_value(role) OVER w AS lead, first_value(turn) OVER w AS head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, role, md5(CASE WHEN turn = head AND role = 'system' THEN 'be brief' || chr(10) || text ELSE text END) AS digest FROM h
  UNION ALL SELECT DISTINCT conv_id, head - 1, 'system', md5('be brief') FROM h WHERE lead <> 'system'""")
def upsert_system_message(t: Tables) -> DataFrame:
    out = turns.upsert_system(t.conversations, F.lit("be brief"))
    return out.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(f"""WITH h AS (SELECT conv_id, min(turn) AS head, bool_or(contains(text, '@')) AS need, bool_or(role = 'system' AND contains(text, '{C.LANGUAGE_MARKER}')) AS told FROM conversations GROUP BY conv_id)
  SELECT conv_id, turn, role, md5(text) AS digest FROM conversations
  UNION ALL SELECT conv_id, head - 1, 'system', md5('{C.LANGUAGE_PROMPT.replace("'", "''")}') FROM h WHERE need AND NOT told""")
def ensure_language_prompt(t: Tables) -> DataFrame:
    out = turns.ensure_language(t.conversations, F.contains("text", F.lit("@")))
    return out.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("""SELECT conv_id, turn, role, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1""")
def latest_user_turn(t: Tables) -> DataFrame:
    return readers.latest_turn(t.conversations, "user").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("""SELECT conv_id, turn, r::INT AS age, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4""")
def recent_history(t: Tables) -> DataFrame:
    return readers.recent_history(t.conversations).select("conv_id", "turn", "age", F.md5("text").alias("digest"))


@query("""WITH h AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id) SELECT (count(*) FILTER (coalesce(u, '') <> ''))::BIGINT AS ok, (count(*) FILTER (coalesce(u, '') = ''))::BIGINT AS rejected FROM h""")
def reject_invalid_prompt(t: Tables) -> DataFrame:
    asked = _per_conversation(t, turns.last_text("user").alias("u"))
    ok, bad = readers.reject_invalid_prompt(asked, "u")
    both = ok.select(F.lit(1).alias("ok"), F.lit(0).alias("rejected")).unionByName(bad.select(F.lit(0).alias("ok"), F.lit(1).alias("rejected")))
    return both.agg(F.sum("ok").alias("ok"), F.sum("rejected").alias("rejected"))


# --- requests and bodies ---------------------------------------------------------------------------------------------


def _requests(t: Tables) -> DataFrame:
    return t.documents.selectExpr("text", *[e.strip() for e in I.REQUEST.replace("\n", " ").split(", ") if e.strip()])


@query(f"SELECT doc_id, md5(text) AS digest FROM documents")
def decode_prompt(t: Tables) -> DataFrame:
    coded = t.documents.select("doc_id", (F.col("doc_id") % 3 == 0).alias("encoding"), F.when(
        F.col("doc_id") % 3 == 0, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text")).alias("prompt"))
    return coded.select("doc_id", F.md5(X.decode_prompt(F.col("prompt"), F.col("encoding"))).alias("digest"))


@query(f"""WITH q AS (SELECT {I.REQUEST}, text FROM documents)
  SELECT session_id, message_id, 'user' AS role, md5(text) AS digest, 'f-' || doc_id AS file_id, strlen(text)::BIGINT AS file_size FROM q""")
def to_body(t: Tables) -> DataFrame:
    files = F.array(F.struct(F.concat(F.lit("f-"), F.col("doc_id").cast("string")).alias("id"), F.octet_length("text").cast("bigint").alias("size"),
                             F.lit("a.txt").alias("name"), F.lit("text/plain").alias("mime_type")))
    body = _requests(t).select(M.to_body(F.col("session_id"), F.col("message_id"), F.col("text"), files).alias("b"))
    return body.select("b.metadata.session_id", "b.metadata.message_id", F.col("b.messages")[0]["role"].alias("role"), F.md5(F.col("b.messages")[0]["content"]).alias("digest"),
                       F.col("b.attach_file")[0]["id"].alias("file_id"), F.col("b.attach_file")[0]["size"].alias("file_size"))


@query(f"""WITH q AS (SELECT {I.REQUEST}, text FROM documents) SELECT session_id, message_id, 'user' AS role, md5(text) AS digest FROM q""")
def to_output_body(t: Tables) -> DataFrame:
    body = _requests(t).select(M.to_output_body(F.col("session_id"), F.col("message_id"), F.col("text")).alias("b"))
    return body.select("b.metadata.session_id", "b.metadata.message_id", F.col("b.messages")[0]["role"].alias("role"), F.md5(F.col("b.messages")[0]["content"]).alias("digest"))


@query(f"SELECT doc_id, {I.RESPONSE_TEXT} AS answer FROM documents")
def extract_response_text(t: Tables) -> DataFrame:
    bodies = t.documents.select("doc_id", F.try_parse_json(F.expr(I.RESPONSE_JSON)).alias("body"))
    return bodies.select("doc_id", M.extract_response_text(F.col("body")).alias("answer"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1)::INT AS k, 'none' AS missing FROM events")
def safe_get(t: Tables) -> DataFrame:
    body = F.try_parse_json("props")
    return t.events.select("event_id", X.safe_get(body, "$.k", "int", F.lit(-1)).alias("k"), X.safe_get(body, "$.a.b", "string", F.lit("none")).alias("missing"))


_CHANNEL = "CASE doc_id % 9 WHEN 1 THEN 'app' WHEN 2 THEN 'mail' WHEN 7 THEN 'app' ELSE 'web' END"
_SID = """CASE doc_id % 9 WHEN 0 THEN 'a' || doc_id WHEN 1 THEN 'b' || doc_id WHEN 2 THEN 'c' || doc_id WHEN 3 THEN 'd' || doc_id
  WHEN 4 THEN 'e' || doc_id WHEN 5 THEN 'f' || doc_id WHEN 6 THEN 'g' || doc_id END"""


@query(f"""SELECT doc_id, coalesce({_SID}, 'ps-' || left(sha1(CASE WHEN doc_id % 2 = 0 THEN 'anon' ELSE 'u' || doc_id % 50 END || ':' || {_CHANNEL} || ':20240102'), 16)) AS session_id,
  {_SID} IS NULL AS is_fallback FROM documents""")
def resolve_session_id(t: Tables) -> DataFrame:
    user = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")))
    bodies = t.documents.select("doc_id", user.alias("user"), F.try_parse_json(F.expr(I.SESSION_JSON)).alias("body"))
    return bodies.select("doc_id", M.resolve_session_id(F.col("body"), F.col("user"), F.lit("20240102")).alias("r")).select("doc_id", "r.*")


@query(f"SELECT doc_id, {_CHANNEL} AS channel FROM documents")
def resolve_channel(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", M.resolve_channel(F.try_parse_json(F.expr(I.SESSION_JSON))).alias("channel"))


@query("SELECT doc_id, CASE doc_id % 9 WHEN 3 THEN '1.1.1.1' WHEN 4 THEN '2.2.2.2' WHEN 5 THEN '3.3.3.3' WHEN 6 THEN '4.4.4.4' END AS ip FROM documents")
def resolve_client_ip(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", M.resolve_client_ip(F.try_parse_json(F.expr(I.SESSION_JSON))).alias("ip"))


@query(f"""WITH q AS (SELECT {I.REQUEST} FROM documents) SELECT CASE WHEN doc_id % 4 = 0 THEN '' ELSE user_id END AS user_id, email, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE ai_service END AS ai_service, '' AS uuid, client_host FROM q""")
def project_identity(t: Tables) -> DataFrame:
    user = F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("user_id")).alias("name"), "email", F.when(F.col("doc_id") % 5 != 0, F.col("ai_service")).alias("ai_service"),
                    F.lit(None).cast("string").alias("uuid"), "client_host")
    return _requests(t).select(user.alias("u")).select(*M.project_identity(F.col("u")))


@query(f"""WITH q AS (SELECT {I.REQUEST} FROM documents) SELECT message_id, email || '_' || ai_service AS user_key FROM q""")
def user_key(t: Tables) -> DataFrame:
    return _requests(t).select("message_id", X.user_key(F.col("email"), F.col("ai_service")).alias("user_key"))


@query("SELECT user_id % 14 AS code, count(*) AS n, max(" + "CASE user_id % 14 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in C.SERVICE_NAMES.items()) + " ELSE '' END) AS ai_service FROM events GROUP BY user_id % 14")
def lookup_service_name(t: Tables) -> DataFrame:
    named = t.events.select((F.col("user_id") % 14).alias("code")).withColumn("ai_service", X.service_name(F.col("code")))
    return named.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("ai_service").alias("ai_service"))


# --- scalar text functions -------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN strlen(text) > 101 THEN left(text, list_max(list_filter(range(0, 102), lambda k: strlen(left(text, k)) <= 101))::INT) ELSE text END AS cut,
  CASE WHEN strlen(text) > 101 THEN strlen(text)::INT END AS original_bytes FROM documents""")
def truncate_utf8(t: Tables) -> DataFrame:
    cut, size = X.truncate_utf8(F.col("text"), 101)
    return t.documents.select("doc_id", cut.alias("cut"), size.alias("original_bytes"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '... (truncated, total=' || length(text) || ')' ELSE text END AS cut FROM documents")
def truncate_chars(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate_chars(F.col("text"), 80).alias("cut"))


@query("SELECT doc_id, left(text, 256) AS chunk FROM documents")
def preview_chunk(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.preview_chunk(F.col("text")).alias("chunk"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE sha256(text) END AS digest FROM documents")
def hash_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.hash_text(F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text"))).alias("digest"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def hash_content(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.hash_content(F.encode("html", "UTF-8")).alias("digest"))


@query("""WITH c AS (SELECT doc_id, text, strlen(text) AS n, left(text, list_max(list_filter(range(0, 201), lambda k: strlen(left(text, k)) <= 200))::INT) AS cut FROM documents)
  SELECT doc_id, 'hash' AS mode, NULL AS text, 0 AS size, sha256(text) AS digest FROM c
  UNION ALL SELECT doc_id, 'text', CASE WHEN n > 200 THEN cut ELSE text END, CASE WHEN n > 200 THEN n::INT END, '' FROM c
  UNION ALL SELECT doc_id, 'none', NULL, 0, '' FROM c""")
def apply_storage_policy(t: Tables) -> DataFrame:
    modes = {"hash": X.apply_storage_policy(F.col("text"), hash_only=True), "text": X.apply_storage_policy(F.col("text"), max_bytes=200),
             "none": X.apply_storage_policy(F.col("text"), store_text=False)}
    rows = F.array(*[F.struct(F.lit(k).alias("mode"), v["text"].alias("text"), v["text_truncated_bytes"].alias("size"), v["hash_sha256"].alias("digest")) for k, v in modes.items()])
    return t.documents.select("doc_id", F.inline(rows))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at FROM events")
def iso_utc(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.iso_utc(F.col("ts")).alias("at"))


@query("SELECT page_id, round(list_aggregate(string_split(url, ''), 'entropy'), 6) AS bits FROM pages")
def shannon_entropy(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.round(X.shannon_entropy(F.col("url")), 6).alias("bits"))


_WORDS = "unnest(string_split_regex(text, '\\s+'))"


@query(f"""SELECT shape, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(w, '{C.BASE64_SHAPE}') THEN 'base64' WHEN regexp_matches(w, '{C.HEX_SHAPE}') THEN 'hex' ELSE 'mixed' END AS shape
  FROM (SELECT {_WORDS} AS w FROM documents)) GROUP BY shape""")
def token_shape(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.split("text", r"\s+")).alias("w"))
    return words.groupBy(X.token_shape(F.col("w")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, d, {I.luhn('d')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS d FROM documents) WHERE length(d) >= 8""")
def luhn_valid(t: Tables) -> DataFrame:
    digits = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("d")).where(F.length("d") >= 8)
    return digits.select("doc_id", "d", X.luhn_valid(F.col("d")).alias("valid"))


@query("SELECT event_id, upper(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END) AS decision FROM events")
def unified_decision(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.unified_decision(F.when(F.col("event_id") % 5 != 0, F.col("event_type"))).alias("decision"))


_ACTION = "CASE event_id % 5 WHEN 0 THEN 'MASKING_REDACT' WHEN 1 THEN 'block_msg' WHEN 2 THEN 'ALLOW' WHEN 3 THEN 'masking' ELSE event_type END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'masking' WHEN 1 THEN 'block' WHEN 3 THEN 'masking' ELSE 'allow' END AS action FROM events")
def std_action(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.std_action(F.expr(_ACTION)).alias("action"))


def _message_sql(title: str, tail: str) -> str:
    return (f"SELECT event_type, '[GUARD] {title}' || chr(10) || 'GUARD 정책에 의해 민감정보가 프롬프트에 포함된 것으로 탐지되었습니다.' || chr(10) || '❌탐지 유형은 ''' "
            f"|| event_type || ''' 입니다.' || chr(10) || {tail} || '세부 지침 사항은 관리자에게 문의해주세요' || chr(10) || '        ' AS message, count(*) AS n FROM events GROUP BY event_type")


@query(_message_sql("프롬프트 차단", "'민감 정보를 전송할 경우, 기밀 정보 또는 개인 정보 유출등의 피해가 발생할 수 있으니 각별한 주의를 부탁드려요' || chr(10) || '요청하신 프롬프트는 GUARD에 의해서 요청이 차단되었습니다.' || chr(10)"))
def block_message(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("message", X.block_message(F.col("event_type")))


@query(_message_sql("프롬프트 마스킹", "''"))
def mask_message(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("message", X.mask_message(F.col("event_type")))
