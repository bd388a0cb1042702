"""Decision, verdict, audit, file and scoring queries."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import catalog as C
from sieveline.functions import pii as P
from sieveline.functions import verdicts as V
from sieveline.functions.blocks import in_blocks
from sieveline.functions.expr import unnest
from sieveline.functions.text import hash_text
from sieveline.operators import audit, files, scoring
from sieveline.operators import decisions as N
from sieveline.plans import inputs as I
from sieveline.plans.registry import Tables, query

# --- filter chain ----------------------------------------------------------------------------------------------------

# Four cheap detectors stand for the filters of a chain: (name, pattern, action)
CHAIN = (("mail_filter", "[a-z][0-9]{3}@", "masking"), ("key_filter", "AKIA[0-9]", "block"), ("digit_filter", "[0-9]{9}", "masking"), ("ip_filter", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "block"))


def _verdicts(t: Tables) -> DataFrame:
    arr = F.array(*[N.verdict(i, name, F.when(F.col("text").rlike(p), action).otherwise("allow"), masked=F.lit(f"masked by {name}"), message=F.lit(f"blocked by {name}"))
                    for i, (name, p, action) in enumerate(CHAIN)])
    return t.probed.select("doc_id", F.concat(F.lit("m-"), F.col("doc_id").cast("string")).alias("message_id"), arr.alias("verdicts"))


_V = "v AS (" + " UNION ALL ".join(
    f"SELECT doc_id, 'm-' || doc_id AS message_id, {i} AS ord, '{n}' AS filter_id, CASE WHEN regexp_matches(text, '{p}') THEN '{a}' ELSE 'allow' END AS action FROM probed"
    for i, (n, p, a) in enumerate(CHAIN)) + ")"
_REACHED = "r AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.action = 'block'))"
_FINAL = """fin AS (SELECT message_id, doc_id, min_by(action, k) AS action, min_by(filter_id, k) AS filter_id, min(k) AS k FROM (
  SELECT *, CASE action WHEN 'block' THEN 0 WHEN 'masking' THEN 100 ELSE 200 END + ord AS k FROM r) GROUP BY message_id, doc_id)"""
_DECIDED = f"{I.PROBED}, {_V}, {_REACHED}, {_FINAL}"


@query(f"WITH {I.PROBED}, {_V}, {_REACHED} SELECT message_id, ord::INT AS ord, filter_id, action FROM r")
def run_filter_chain(t: Tables) -> DataFrame:
    return unnest(_verdicts(t), ["message_id"], N.run_filter_chain(F.col("verdicts")), "ord").select("message_id", "ord", "filter_id", "action")


def _long(t: Tables) -> DataFrame:
    return unnest(_verdicts(t), ["message_id"], F.col("verdicts"), "ord")


@query(f"WITH {I.PROBED}, {_V}, {_REACHED} SELECT message_id, ord::INT AS ord, filter_id, action FROM r")
def run_filter_chain_table(t: Tables) -> DataFrame:
    return N.run_filter_chain_table(_long(t)).select("message_id", "ord", "filter_id", "action")


_FINAL_COLUMNS = """SELECT message_id, action, (CASE action WHEN 'block' THEN 1 WHEN 'masking' THEN 2 ELSE 0 END)::INT AS action_code,
  CASE WHEN action <> 'allow' THEN 'masked by ' || filter_id ELSE '' END AS masked_contents, CASE WHEN action <> 'allow' THEN 'blocked by ' || filter_id ELSE '' END AS block_message FROM fin"""


@query(f"WITH {_DECIDED} {_FINAL_COLUMNS}")
def final_decision(t: Tables) -> DataFrame:
    return _verdicts(t).select("message_id", N.final_decision(N.run_filter_chain(F.col("verdicts"))).alias("d")).select("message_id", "d.*")


@query(f"WITH {_DECIDED} {_FINAL_COLUMNS}")
def final_decision_table(t: Tables) -> DataFrame:
    return N.final_decision_table(_long(t), stop_at_block=True)


@query(f"""WITH {I.PROBED}, {_V}, f AS (SELECT doc_id, min(ord) AS stop, min_by(filter_id, ord) AS by_ FROM v WHERE action = 'block' GROUP BY doc_id)
  SELECT message_id, ord::INT AS ord, filter_id, coalesce(ord > stop, false) AS skipped, CASE WHEN ord > stop THEN by_ END AS skipped_by FROM v LEFT JOIN f USING (doc_id)""")
def skip_after_upstream_block(t: Tables) -> DataFrame:
    stages = F.transform("verdicts", lambda v: F.struct(v["ord"].alias("ord"), v["filter_id"].alias("filter_id"), (v["action"] == "block").alias("should_block"), v["action"].alias("action")))
    return unnest(_verdicts(t), ["message_id"], N.skip_after_upstream_block(stages), "ord")


def _echoes(t: Tables) -> DataFrame:
    decided = _verdicts(t).select("doc_id", "message_id", N.final_decision(F.col("verdicts")).alias("d"))
    request = [e.strip() for e in I.REQUEST.replace("\n", " ").split(", ")][2:]
    return N.echo_block_response(decided.selectExpr("doc_id", "message_id", *request, "d.action_code", "d.block_message"))


_ECHO = "SELECT 'blocked by ' || filter_id AS llm_output, 'user' || (doc_id % 50) AS user_id, (doc_id % 6)::INT AS ai_service, message_id FROM fin WHERE action = 'block'"


@query(f"WITH {_DECIDED} {_ECHO}")
def echo_block_response(t: Tables) -> DataFrame:
    return _echoes(t).select("llm_output", "user_id", "ai_service", "message_id")


@query(f"WITH {_DECIDED} {_ECHO} UNION ALL SELECT md5(text), 'c' || conv_id, 0, 'm-' || conv_id FROM conversations WHERE role = 'assistant'")
def union_outputs(t: Tables) -> DataFrame:
    outputs = t.conversations.where(F.col("role") == "assistant").select(F.md5("text").alias("llm_output"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("user_id"),
                                                                        F.lit(0).alias("ai_service"), F.concat(F.lit("m-"), F.col("conv_id").cast("string")).alias("message_id"))
    return N.union_outputs(outputs, _echoes(t).select("llm_output", "user_id", "ai_service", "message_id"))


@query("""WITH p AS (SELECT 'm-' || conv_id || '-' || turn AS message_id, md5(text) AS prompt FROM conversations WHERE role = 'user'),
  o AS (SELECT 'm-' || conv_id || '-' || (turn - 1) AS message_id, md5(text) AS llm_output FROM conversations WHERE role = 'assistant') SELECT message_id, prompt, llm_output FROM p LEFT JOIN o USING (message_id)""")
def attach_output_to_prompt(t: Tables) -> DataFrame:
    def keyed(role: str, shift: int, name: str) -> DataFrame:
        key = F.concat_ws("-", F.lit("m"), "conv_id", F.col("turn") - shift)
        return t.conversations.where(F.col("role") == role).select(key.alias("message_id"), F.md5("text").alias(name))

    return N.attach_output_to_prompt(keyed("user", 0, "prompt"), keyed("assistant", 1, "llm_output"))


@query(f"""WITH {I.PROBED} SELECT doc_id, regexp_matches(text, '[a-z][0-9]{{3}}@') OR regexp_matches(text, '(?i)hunter') AS should_block FROM probed""")
def should_block(t: Tables) -> DataFrame:
    scan = P.scan_first_match(F.col("text"), ["hunter"])
    return t.probed.select("doc_id", P.should_block(F.col("text").rlike("[a-z][0-9]{3}@"), scan["decision"]).alias("should_block"))


_HAS = f"h AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id)"


@query(f"""WITH {I.HITS}, {_HAS} SELECT p.doc_id, CASE WHEN n > 0 THEN 'BLOCK_MSG' ELSE 'ALLOW' END AS final_action, CASE WHEN n > 0 THEN 'block' ELSE 'allow' END AS action,
  coalesce(n > 0, false) OR regexp_matches(text, '(?i)hunter') AS should_block FROM probed p LEFT JOIN h USING (doc_id)""")
def regex_policy_action(t: Tables) -> DataFrame:
    out = N.regex_filter(t.probed, "text", policy="block", patterns=["hunter"])
    return out.select("doc_id", "final_action", "action", "should_block")


@query(f"""WITH {I.PROBED} SELECT doc_id, regexp_matches(text, '[a-z][0-9]{{3}}@') AS mail, regexp_matches(text, 'AKIA[0-9]') AS secret, CASE WHEN regexp_matches(text, 'AKIA[0-9]') THEN 'block' WHEN regexp_matches(text, '[a-z][0-9]{{3}}@') THEN 'masking' ELSE 'allow' END AS action FROM probed""")
def compose_filters(t: Tables) -> DataFrame:
    chain = [lambda d: d.withColumn("mail", F.col("text").rlike("[a-z][0-9]{3}@")), lambda d: d.withColumn("secret", F.col("text").rlike("AKIA[0-9]")),
             lambda d: d.withColumn("action", F.when(F.col("secret"), "block").when(F.col("mail"), "masking").otherwise("allow"))]
    return N.compose_filters(t.probed, chain).select("doc_id", "mail", "secret", "action")


# --- model verdicts --------------------------------------------------------------------------------------------------

# Each vector as the logits of as many classes as it has fields.
_LOGITS = "embedding"


@query(f"""WITH e AS (SELECT vec_id, list_transform({_LOGITS}, lambda x: exp(x::DOUBLE)) AS p FROM embeddings), q AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p FROM e),
  c AS (SELECT vec_id, list_max(p) AS conf, list_position(p, list_max(p)) - 1 AS cls FROM q)
  SELECT vec_id, cls = 0 AS safe, CASE WHEN cls = 0 THEN 'SAFE' ELSE 'UNSAFE' END AS label, CASE cls WHEN 0 THEN NULL WHEN 1 THEN 'jailbreak' WHEN 2 THEN 'injection' ELSE 'unsafe_class_' || cls END AS reason, round(conf, 5) AS confidence FROM c""")
def attack_label(t: Tables) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double"))
    probs = t.embeddings.select("vec_id", V.softmax(logits).alias("p"))
    return probs.select("vec_id", V.attack_label(F.col("p")).alias("l")).select("vec_id", "l.safe", "l.label", "l.reason", F.round("l.confidence", 5).alias("confidence"))


@query("""SELECT vec_id, CASE WHEN list_position(embedding, list_max(embedding)) = 1 THEN 'allow' ELSE 'block' END AS action FROM embeddings""")
def attack_action(t: Tables) -> DataFrame:
    probs = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", V.attack_action(V.attack_label(probs))["action"].alias("action"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'block' ELSE 'allow' END AS action, CASE doc_id % 6 WHEN 0 THEN 'Safety: Safe; Categories: None' WHEN 1 THEN 'Safety: Unsafe; Categories: PII' WHEN 2 THEN 'safety: unsafe' END AS content FROM documents")
def parse_safety_response(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", V.parse_safety_response(F.expr(I.SAFETY_RAW)).alias("v")).select("doc_id", "v.*")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'masking' ELSE 'allow' END AS action, (CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 0 END)::INT AS action_code,
  event_type = 'error' AS has_message, event_type = 'click' AS has_mask FROM events""")
def map_policy_action(t: Tables) -> DataFrame:
    rule = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "click", "masking").otherwise("accept")
    return t.events.select("event_id", V.map_policy_action(rule, F.col("event_type")).alias("m")).select(
        "event_id", "m.action", "m.action_code", (F.col("m.block_message") != "").alias("has_message"), (F.col("m.masked_contents") != "").alias("has_mask"))


_VERDICT_SQL = """vr AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'allow' WHEN 5 THEN 'allow' ELSE 'block' END AS decision,
  CASE doc_id % 9 WHEN 0 THEN [] WHEN 1 THEN ['email_address', 'phone_number'] WHEN 2 THEN ['card' || (doc_id % 7)] WHEN 3 THEN ['invalid_decision_value', 'unsure'] WHEN 4 THEN ['a', 'b']
    WHEN 5 THEN ['public'] WHEN 6 THEN ['empty_response'] WHEN 7 THEN ['invalid_json_output'] ELSE ['address'] END AS reasons FROM documents)"""


def _recovered(t: Tables) -> DataFrame:
    answers = t.documents.select("doc_id", F.expr(I.VERDICT_RAW).alias("raw"))
    return V.recover_verdicts(answers, F.col("raw"), "v").select("doc_id", "v.*")


@query(f"WITH {_VERDICT_SQL} SELECT doc_id, decision, array_to_string(reasons, ',') AS reasons FROM vr")
def recover_verdict_json(t: Tables) -> DataFrame:
    return _recovered(t).select("doc_id", "decision", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_VERDICT_SQL} SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'address,email,phone' WHEN 2 THEN 'account' WHEN 8 THEN 'address' ELSE '' END AS types FROM vr""")
def reasons_to_types(t: Tables) -> DataFrame:
    return _recovered(t).select("doc_id", F.array_join(V.reasons_to_types(F.col("reasons")), ",").alias("types"))


@query(f"""WITH {_VERDICT_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(reasons, ['again', lang]))), ',') AS reasons FROM vr JOIN documents USING (doc_id)""")
def distinct_reasons(t: Tables) -> DataFrame:
    answers = t.documents.select("doc_id", "lang", F.expr(I.VERDICT_RAW).alias("raw"))
    told = V.recover_verdicts(answers, F.col("raw"), "v").select("doc_id", "lang", F.col("v.reasons").alias("r"))
    twice = F.concat("r", F.array(F.lit("again"), F.col("lang")), F.col("r"))
    return told.select("doc_id", F.array_join(V.distinct_reasons(twice), ",").alias("reasons"))


@query(f"""WITH {_VERDICT_SQL} SELECT doc_id, '{C.MODEL_BLOCK_GUIDE}' || chr(10) || chr(10) || '{C.MODEL_BLOCK_CAUSE}: ' || CASE WHEN len(reasons) = 0 THEN 'unspecified' ELSE array_to_string(reasons, ', ') END
  || chr(10) || chr(10) || '{C.MODEL_BLOCK_IDS}: message_id=m' || doc_id AS message FROM vr""")
def build_llm_block_message(t: Tables) -> DataFrame:
    ids = {"message_id": F.concat(F.lit("m"), F.col("doc_id").cast("string")), "session_id": F.lit("")}
    return _recovered(t).select("doc_id", V.build_model_block_message(F.col("reasons"), ids).alias("message"))


@query("SELECT event_id, 'block' AS decision, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'empty_response' ELSE 'llm_json_parse_recovered' END AS reason FROM events")
def fail_closed(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "empty_response").otherwise(F.col("event_type"))
    return t.events.select("event_id", V.fail_closed(status).alias("v")).select("event_id", "v.decision", F.element_at("v.reasons", 1).alias("reason"))


# Answers: a JSON list for the first line, a broken list, a timeout, an error.
_LINE_RAW = """(CASE doc_id % 4 WHEN 0 THEN '[{"line":1,"risk":"risky","original":"x","reasons":["phone","email"],"confidence":0.9},{"line":2,"risk":"safe","original":"y","reasons":["n"],"confidence":1.0}]'
  WHEN 1 THEN '[{"line": broken' END)"""


def _lines(t: Tables) -> DataFrame:
    status = F.when(F.col("doc_id") % 4 == 2, "timeout").when(F.col("doc_id") % 4 == 3, "error")
    return t.documents.select("doc_id", V.recover_line_verdicts(F.expr(_LINE_RAW), F.col("text"), status).alias("lines"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 ELSE len(string_split(text, chr(10))) END::INT AS n, CASE doc_id % 4 WHEN 0 THEN 'phone' WHEN 1 THEN 'json_parse_error' WHEN 2 THEN 'llm_timeout' ELSE 'llm_error' END AS reason,
  CASE doc_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM documents""")
def recover_line_verdicts(t: Tables) -> DataFrame:
    first = F.element_at("lines", 1)
    return _lines(t).select("doc_id", F.size("lines").alias("n"), F.element_at(first["reasons"], 1).alias("reason"), first["confidence"].alias("confidence"))


@query("""SELECT doc_id, 'block' AS decision, CASE doc_id % 4 WHEN 0 THEN 'email,phone' WHEN 1 THEN 'json_parse_error' WHEN 2 THEN 'llm_timeout' ELSE 'llm_error' END AS reasons,
  CASE doc_id % 4 WHEN 0 THEN 1 ELSE len(string_split(text, chr(10))) END::INT AS n_risky FROM documents""")
def line_verdict_summary(t: Tables) -> DataFrame:
    return _lines(t).select("doc_id", V.line_verdict_summary(F.col("lines")).alias("s")).select("doc_id", "s.decision", F.array_join("s.reasons", ",").alias("reasons"), F.size("s.risky_lines").alias("n_risky"))


@query("SELECT event_id, event_type = 'error' OR value > 10 AS hit FROM events")
def truthy_decision(t: Tables) -> DataFrame:
    decision = F.when(F.col("event_type") == "error", "flag").otherwise(F.col("event_type"))
    return t.events.select("event_id", V.truthy_decision(decision, F.greatest(F.col("value") - 10, F.lit(0.0))).alias("hit"))


_SCAN_JSON = """(CASE doc_id % 4 WHEN 0 THEN '{"spans":[{"start":0,"end":3,"type":"a","value":"v"},{"start":5,"end":2}],"matches":[{"span":{"start":1,"end":4},"kind":"k","text":"t"}]}'
  WHEN 1 THEN '{"entities":[{"start":0,"end":99999999,"label":"l"}]}' WHEN 2 THEN '{"results":[{"start":2,"end":5,"label":"l","match":"m"}]}' ELSE 'oops' END)"""


@query("""SELECT doc_id, 0 AS start, 3 AS "end", 'a' AS type, 'v' AS value FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 1, 4, 'k', 't' FROM documents WHERE doc_id % 4 = 0 AND length(text) >= 4
  UNION ALL SELECT doc_id, 2, 5, 'l', 'm' FROM documents WHERE doc_id % 4 = 2 AND length(text) >= 5""")
def normalize_scanner_spans(t: Tables) -> DataFrame:
    return unnest(t.documents, ["doc_id"], V.normalize_scanner_spans(F.expr(_SCAN_JSON), F.col("text")), "start")


def _stub_scorer():
    """Stands for a hosted safety model: answers in its chat format, unsafe when a key id occurs."""
    def score(texts):
        return [json.dumps({"choices": [{"message": {"content": "Safety: Unsafe" if "AKIA" in x else "Safety: Safe"}}]}) for x in texts]

    return score


@query(f"WITH {I.PROBED} SELECT doc_id, CASE WHEN contains(text, 'AKIA') THEN 'block' ELSE 'allow' END AS action, NULL AS status FROM probed")
def score_text(t: Tables) -> DataFrame:
    scored = scoring.score_text(t.probed, ["doc_id"], "text", _stub_scorer)
    return scored.select("doc_id", V.parse_safety_response(F.col("response"))["action"].alias("action"), "status")


def _length_scorer():
    """A scorer of the user's own: anything that maps a batch of texts to answers."""
    return lambda texts: [str(len(x)) for x in texts]


@query("SELECT page_id, length(html)::VARCHAR AS response, NULL AS status FROM pages")
def custom_scorer(t: Tables) -> DataFrame:
    return scoring.score_text(t.pages.select("page_id", "html"), ["page_id"], "html", _length_scorer)


# --- files -----------------------------------------------------------------------------------------------------------

_KINDS = ("application/pdf", "application/msword", "application/zip", "image/png", "text/plain", files.DOCX_MIME)
_HEADS = ("255044462D312E34", "D0CF11E0A1B11AE1", "504B03040A00", "89504E470D0A1A0A", "", "504B0304" + "[Content_Types].xml".encode().hex().upper())


def _files(t: Tables) -> DataFrame:
    """Each document as a file of some type: a type's leading bytes in front of the text."""
    heads = F.array(*[F.lit(h) for h in _HEADS])
    head = F.unhex(F.element_at(heads, (F.col("doc_id") % len(_HEADS) + 1).cast("int")))
    content = F.concat(head, F.encode("text", "UTF-8"))
    out = t.documents.select("doc_id", F.concat(F.lit("m-"), (F.col("doc_id") % 211).cast("string")).alias("message_id"), F.concat(F.lit("/f/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))
    return out.withColumn("length", F.octet_length("content").cast("bigint"))


_MIME = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_KINDS)) + " END"
_EXT = "CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'hwpx' WHEN 5 THEN 'docx' ELSE 'unknown' END"
_SIZE = "(strlen(text) + CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {len(h) // 2}" for i, h in enumerate(_HEADS)) + " END)"
_GATE = f"""CASE WHEN {_EXT} NOT IN ('doc', 'docx', 'hwp', 'hwpx', 'pdf') THEN 'not allowed file extension (doc,docx,hwp,hwpx,pdf)' WHEN {_SIZE} > 5000 THEN 'fize size exceeds limit (5000)' ELSE '' END"""


@query(f"SELECT doc_id, {_MIME} AS mime_type FROM documents")
def sniff_mime(t: Tables) -> DataFrame:
    return _files(t).select("doc_id", files.sniff_mime(F.col("content")).alias("mime_type"))


@query(f"SELECT doc_id, {_EXT} AS file_ext FROM documents")
def mime_to_ext(t: Tables) -> DataFrame:
    return _files(t).select("doc_id", files.mime_to_ext(files.sniff_mime(F.col("content"))).alias("file_ext"))


def _gated(t: Tables) -> DataFrame:
    typed = _files(t).withColumn("file_ext", files.mime_to_ext(files.sniff_mime(F.col("content"))))
    return typed.select("doc_id", "message_id", files.file_gate(F.col("file_ext"), F.col("length"), max_size=5000).alias("g"))


@query(f"SELECT doc_id, {_GATE} = '' AS allowed, {_GATE} AS reason FROM documents")
def file_gate(t: Tables) -> DataFrame:
    return _gated(t).select("doc_id", "g.allowed", "g.reason")


@query(f"""SELECT 'm-' || (doc_id % 211) AS message_id, CASE WHEN bool_or({_GATE} <> '') THEN 'block' ELSE 'allow' END AS action, count(*) AS n_files, count(*) FILTER ({_GATE} <> '') AS n_blocked FROM documents GROUP BY ALL""")
def bundle_file_decision(t: Tables) -> DataFrame:
    verdicts = _gated(t).select("message_id", F.when(F.col("g.allowed"), "").otherwise("block").alias("action"))
    return files.bundle_file_decision(verdicts)


@query("SELECT '/f/' || doc_id AS path, md5(text) AS digest, NULL AS error FROM documents")
def extract_file_text(t: Tables) -> DataFrame:
    plain = t.documents.select(F.concat(F.lit("/f/"), F.col("doc_id").cast("string")).alias("path"), F.lit("text/plain").alias("mime_type"), F.encode("text", "UTF-8").alias("content"))
    return files.extract_file_text(plain).select("path", F.md5("text").alias("digest"), "error")


def _zipped(text: str | None) -> bytes | None:
    if text is None:
        return None
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@F.arrow_udf(T.BinaryType())
def _docx(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return in_blocks(((t,) for t in texts), _zipped, pa.binary(), lambda zipped: len(zipped or b""))


@query("SELECT '/f/' || doc_id AS path, md5(text) AS digest, NULL AS error FROM documents")
def extract_zip_text(t: Tables) -> DataFrame:
    zipped = t.documents.select(F.concat(F.lit("/f/"), F.col("doc_id").cast("string")).alias("path"), _docx("text").alias("content"))
    typed = zipped.withColumn("mime_type", files.sniff_mime(F.col("content")))
    return files.extract_file_text(typed).select("path", F.md5("text").alias("digest"), "error")


# Which words make a text unsafe is learned, so the twin tells what can be known: every text is scored, and both labels are told well.
@query("""SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_labelled, true AS tells_unsafe, true AS tells_safe FROM documents JOIN labels USING (doc_id)""")
def train_safety_classifier(t: Tables) -> DataFrame:
    from sieveline.operators import safety

    model = safety.train_safety_classifier(t.documents, t.labels)
    told = safety.score_safety(model, t.documents).join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    right = lambda toxic: F.avg(F.when(F.col("toxic") == toxic, (F.col("unsafe").cast("int") == toxic).cast("double"))) >= 0.9
    return told.agg(F.count("unsafe").alias("n_docs"), F.count("toxic").alias("n_labelled"), right(1).alias("tells_unsafe"), right(0).alias("tells_safe"))


def _html_text(content: bytes) -> str:
    return content.decode("utf-8").replace("<", "[").replace(">", "]")


@query("SELECT url || '#' || page_id AS path, md5(replace(replace(html, '<', '['), '>', ']')) AS digest, NULL AS error FROM pages")
def custom_extractor(t: Tables) -> DataFrame:
    given = t.pages.select(F.concat_ws("#", "url", "page_id").alias("path"), F.lit("text/html").alias("mime_type"), F.encode("html", "UTF-8").alias("content"))
    return files.extract_file_text(given, extractors={"text/html": _html_text}).select("path", F.md5("text").alias("digest"), "error")


@query(f"""WITH {I.PROBED} SELECT '/f/' || doc_id AS path, CASE WHEN strlen(text) > 20000 THEN 'block' WHEN contains(text, 'AKIA') THEN 'block' WHEN contains(text, 'hunter') THEN 'masking' ELSE '' END AS action,
  CASE WHEN strlen(text) > 20000 THEN 'fize size exceeds limit (20000)' WHEN contains(text, 'AKIA') THEN 'aws' WHEN contains(text, 'hunter') THEN 'password' ELSE '' END AS policy_name, sha256(text) AS hash,
  CASE WHEN strlen(text) <= 20000 THEN md5(left(text, 256)) END AS chunk FROM probed""")
def scan_files(t: Tables) -> DataFrame:
    from sieveline.operators.rules import as_rules

    rules = as_rules([("aws", "AKIA", "block", 0, None), ("password", "hunter", "masking", 0, None)])
    given = t.probed.select(F.lit("m").alias("message_id"), F.concat(F.lit("/f/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    given = given.withColumn("length", F.octet_length("content").cast("bigint"))
    # Plain text is admitted here by treating its extension, unknown, as allowed.
    verdicts = files.scan_files(given, rules, allow_ext=("unknown", "doc"), max_size=20_000)
    return verdicts.select("path", "action", "policy_name", "file_info.hash", F.md5("file_info.chunk").alias("chunk"))


@query("SELECT sum(strlen(text) + 1)::BIGINT AS n_bytes, sum(len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, true AS whole FROM documents")
def scan_attachments(t: Tables) -> DataFrame:
    """Documents written as files and read back as attachments, contents and all."""
    from sieveline.sources.readers import scan_attachments as scan

    path = t.work("attachments")
    t.documents.select("text").write.text(path)
    found = scan(t.spark, path, glob="part-*").select("length", "content")
    whole = F.octet_length("content") == F.col("length")
    lines = F.octet_length("content") - F.octet_length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return found.agg(F.sum("length").alias("n_bytes"), F.sum(lines.cast("bigint")).alias("n_lines"), F.bool_and(whole).alias("whole"))


@query("SELECT sum(strlen(text) + 1)::BIGINT AS n_bytes, sum(len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, true AS gapless FROM documents")
def scan_file_chunks(t: Tables) -> DataFrame:
    """The same files by byte ranges: every byte is in exactly one chunk, whatever surroundings chunks carry."""
    from sieveline.sources.file_chunks import scan_chunks

    path = t.work("chunked")
    t.documents.select("text").write.text(path)
    core = F.substring(F.col("content"), F.col("lead") + 1, (F.col("stop") - F.col("start")).cast("int"))
    chunks = scan_chunks(t.spark, path, "part-*", chunk=1 << 16, overlap=1 << 10).select("path", "length", "start", "stop", core.alias("core"))
    lines = F.octet_length("core") - F.octet_length(F.replace(F.col("core").cast("string"), F.lit("\n"), F.lit("")))
    files_ = chunks.groupBy("path").agg(F.sum(F.octet_length("core")).alias("n_bytes"), F.sum(lines).alias("n_lines"),
                                        (F.sum(F.col("stop") - F.col("start")) == F.max("length")).alias("gapless"))
    return files_.agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_lines").alias("n_lines"), F.bool_and("gapless").alias("gapless"))


# --- audit documents -------------------------------------------------------------------------------------------------

_AT = "timestamp_seconds(1704067200 + doc_id)"
_AT_SQL = "strftime(to_timestamp(1704067200 + doc_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
_NAMES = "CASE doc_id % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'gpt' WHEN 2 THEN 'gemini' WHEN 3 THEN 'claude' WHEN 4 THEN 'grok' ELSE '' END"


def _request(t: Tables, source: DataFrame) -> DataFrame:
    return source.selectExpr("text", f"{_AT} AS at", *[e.strip() for e in I.REQUEST.replace("\n", " ").split(", ")])


def _c(name: str) -> Column:
    return F.col(name)


@query(f"""SELECT 'm-' || doc_id AS id, {_AT_SQL} AS at, 'query' AS type, 's-' || (doc_id % 97) AS session, 'user' || (doc_id % 50) AS user_id, 'web' AS channel, {_NAMES} AS ai_service, '10.0.0.' || (doc_id % 250) AS ip, md5(text) AS digest FROM documents""")
def audit_input_doc(t: Tables) -> DataFrame:
    doc = audit.audit_input_doc(at=_c("at"), message_id=_c("message_id"), session_id=_c("session_id"), user_id=_c("user_id"), email=_c("email"), uuid=F.lit(""), client_host=_c("client_host"),
                                ai_service=_c("ai_service"), text=_c("text"))
    return _request(t, t.documents).select(doc.alias("d")).select("d.request.id", F.col("d.@timestamp").alias("at"), "d.event.type", F.col("d.session.id").alias("session"), F.col("d.user.id").alias("user_id"),
                                                                  "d.channel", "d.ai_service", "d.src.ip", F.md5("d.query.text").alias("digest"))


@query(f"""WITH {I.HITS}, g AS (SELECT doc_id, string_agg(type, ',' ORDER BY {{order}}) AS types FROM hits GROUP BY doc_id)
  SELECT 'm-' || p.doc_id AS id, CASE WHEN types IS NULL THEN 'pass' ELSE 'hit' END AS detection, CASE WHEN types IS NULL THEN 'allow' ELSE 'masking' END AS mode, false AS should_block, types, sha256(text) AS content
  FROM probed p LEFT JOIN g USING (doc_id)""".replace("{order}", "CASE type " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(dict.fromkeys([p.type for p in C.PII_DETECTION] + list(C.CARD_TYPES)))) + " END"))
def audit_detect_doc(t: Tables) -> DataFrame:
    found = _request(t, t.probed).withColumn("hits", P.detect_pii(_c("text")))
    has = F.size("hits") > 0
    doc = audit.audit_detect_doc(at=_c("at"), stage="regex", message_id=_c("message_id"), session_id=_c("session_id"), user_id=_c("user_id"), email=_c("email"), uuid=F.lit(""), client_host=_c("client_host"),
                                 ai_service=_c("ai_service"), action=F.when(has, "masking").otherwise("allow"), types=F.when(has, F.map_keys("hits")), samples=P.sample_first_per_type(P.mask_hits(_c("hits"))),
                                 content=hash_text(_c("text")), masked=F.lit(""))
    return found.select(doc.alias("d")).select("d.request.id", "d.detection", "d.mode", "d.should_block", F.array_join("d.pii.types", ",").alias("types"), "d.content")


@query(f"""SELECT 'm-' || doc_id AS id, 'm-' || doc_id AS event_id, left(text, 20) AS text, CASE WHEN length(text) > 20 THEN strlen(text)::INT END AS cut_from, (doc_id % 1000)::INT AS latency_ms, true AS present FROM documents WHERE regexp_matches(left(text, 20), '^[\\x00-\\x7F]*$')
  UNION ALL SELECT 'm-' || doc_id, 'm-' || doc_id, left(text, list_max(list_filter(range(0, 21), lambda k: strlen(left(text, k)) <= 20))::INT), CASE WHEN strlen(text) > 20 THEN strlen(text)::INT END, (doc_id % 1000)::INT, true FROM documents WHERE NOT regexp_matches(left(text, 20), '^[\\x00-\\x7F]*$')""")
def audit_output_doc(t: Tables) -> DataFrame:
    null_int = F.lit(None).cast("int")
    doc = audit.audit_output_doc(at=_c("at"), message_id=_c("message_id"), session_id=_c("session_id"), response=_c("text"), response_id=F.lit(None).cast("string"), user_id=_c("user_id"), email=_c("email"),
                                 uuid=F.lit(""), client_host=_c("client_host"), ai_service=_c("ai_service"), model=F.lit("m"), latency_ms=(_c("doc_id") % 1000).cast("int"), prompt_tokens=null_int,
                                 completion_tokens=null_int, total_tokens=null_int, filters=F.lit(None).cast("string"), max_bytes=20)
    return _request(t, t.documents).select(doc.alias("d")).select("d.request.id", F.col("d.event.id").alias("event_id"), "d.response.text", F.col("d.response.text_truncated_bytes").alias("cut_from"),
                                                                  "d.response.latency_ms", "d.session.present")
