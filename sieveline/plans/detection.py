"""Detection queries: personal data, secrets, obfuscation, code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import code as D
from sieveline.functions import obfuscation as O
from sieveline.functions import pii as P
from sieveline.functions import secrets as K
from sieveline.functions import text as X
from sieveline.functions.expr import let, unnest, unnest_map
from sieveline.plans import inputs as I
from sieveline.plans.registry import Tables, query

def _text() -> Column:
    return F.col("text")


def _hits(t: Tables, **options) -> DataFrame:
    return t.probed.select("doc_id", "lang", P.detect_pii(_text(), **options).alias("hits"))


# --- personal data ---------------------------------------------------------------------------------------------------


@query(f"""WITH {I.HITS} SELECT lang, type, count(*) AS n_docs, sum(len(vals))::BIGINT AS n_values FROM hits GROUP BY lang, type""")
def pii_by_language(t: Tables) -> DataFrame:
    long = unnest_map(_hits(t), ["lang"], F.col("hits"), "type", "vals")
    return long.groupBy("lang", "type").agg(F.count("vals").alias("n_docs"), F.sum(F.size("vals")).alias("n_values"))


@query(f"""WITH {I.HITS} SELECT doc_id, type, len(vals)::INT AS n, array_to_string(vals, '|') AS vals FROM hits""")
def detect_pii(t: Tables) -> DataFrame:
    return unnest_map(_hits(t), ["doc_id"], F.col("hits"), "type", "v").select(
        "doc_id", "type", F.size("v").alias("n"), F.array_join("v", "|").alias("vals"))


@query(f"""WITH {I.FLAT}, {I.CARDS} SELECT doc_id, coalesce(ok[1], '') AS card,
  CASE WHEN len(ok) = 0 THEN array_to_string({I.distinct_in_order('cs')}, '|') ELSE '' END AS candidates
  FROM card_hits WHERE len(cs) > 0""")
def detect_card(t: Tables) -> DataFrame:
    rows = let(P.card_values(_text()), lambda c: F.filter(F.array(c), lambda x: F.size(F.concat(x["card"], x["candidates"])) > 0))
    return unnest(t.probed, ["doc_id"], rows, "card").select(
        "doc_id", F.array_join("card", "|").alias("card"), F.array_join("candidates", "|").alias("candidates"))


@query(f"""WITH {I.HITS} SELECT doc_id, type, len(vals)::INT AS n FROM hits WHERE type IN ('email', 'ip', 'phone')""")
def filter_enabled_types(t: Tables) -> DataFrame:
    kept = unnest_map(_hits(t), ["doc_id"], P.filter_enabled_types(F.col("hits"), ["email", "ip", "phone"]), "type", "v")
    return kept.select("doc_id", "type", F.size("v").alias("n"))


_TOKEN_CASE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PII_TOKENS.items()) + f" ELSE '{C.PII_TOKEN_OTHER}' END"


@query(f"""WITH {I.HITS} SELECT doc_id, type, array_to_string(list_transform(vals, lambda v: {_TOKEN_CASE}), '|') AS masked FROM hits""")
def mask_hits(t: Tables) -> DataFrame:
    return unnest_map(_hits(t), ["doc_id"], P.mask_hits(F.col("hits")), "type", "v").select(
        "doc_id", "type", F.array_join("v", "|").alias("masked"))


@query(f"""WITH {I.HITS} SELECT doc_id, type, len(vals)::INT AS n FROM hits""")
def annotate_counts(t: Tables) -> DataFrame:
    return unnest_map(_hits(t), ["doc_id"], P.annotate_counts(F.col("hits")), "type", "n")


_TYPE_ORDER = ("CASE type " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(
    dict.fromkeys([p.type for p in C.PII_DETECTION] + list(C.CARD_TYPES)))) + " END")


@query(f"""WITH {I.HITS} SELECT doc_id, string_agg({_TOKEN_CASE}, ', ' ORDER BY {_TYPE_ORDER}) AS samples FROM hits GROUP BY doc_id""")
def sample_first_per_type(t: Tables) -> DataFrame:
    samples = P.sample_first_per_type(P.mask_hits(F.col("hits")))
    return unnest(_hits(t), ["doc_id"], F.array(F.struct(samples.alias("samples"))), "samples")


@query(f"""WITH {I.HITS} SELECT doc_id, '{C.NOTICE_HEADER}' || chr(10) || '{C.NOTICE_TYPES}: ' || string_agg(type, ', ' ORDER BY {_TYPE_ORDER})
  || chr(10) || '{C.NOTICE_SAMPLES}: ' || string_agg(type || '=' || {_TOKEN_CASE}, ', ' ORDER BY {_TYPE_ORDER}) AS notice FROM hits GROUP BY doc_id""")
def build_ui_notice(t: Tables) -> DataFrame:
    notice = let(F.col("hits"), lambda h: F.when(F.size(h) > 0, P.build_ui_notice(h, "message_with_mask_info")))
    return unnest(_hits(t), ["doc_id"], F.array(F.struct(notice.alias("notice"))), "notice")


@query(f"""WITH {I.HITS} SELECT doc_id, type, i::INT AS rank, vals[i] AS value FROM (SELECT *, unnest(range(1, least(len(vals), 5) + 1)) AS i FROM hits)""")
def top_values_per_type(t: Tables) -> DataFrame:
    return unnest_map(_hits(t, max_per_type=5), ["doc_id"], F.col("hits"), "type", "v").select(
        "doc_id", "type", F.posexplode("v").alias("pos", "value")).select("doc_id", "type", (F.col("pos") + 1).alias("rank"), "value")


@query(f"""WITH {I.PROBED} SELECT doc_id,
  CASE WHEN regexp_matches(text, '(?i)password') OR regexp_matches(text, '(?i)AKIA[0-9A-Z]{{16}}') OR regexp_matches(text, '(?i)begin rsa') THEN 'FLAG' ELSE 'ALLOW' END AS decision,
  CASE WHEN regexp_matches(text, '(?i)password') OR regexp_matches(text, '(?i)AKIA[0-9A-Z]{{16}}') OR regexp_matches(text, '(?i)begin rsa') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
  CASE WHEN regexp_matches(text, '(?i)password') THEN 'pattern matched: password' WHEN regexp_matches(text, '(?i)AKIA[0-9A-Z]{{16}}') THEN 'pattern matched: AKIA[0-9A-Z]{{16}}'
       WHEN regexp_matches(text, '(?i)begin rsa') THEN 'pattern matched: begin rsa' ELSE 'no match' END AS reason FROM probed""")
def scan_first_match(t: Tables) -> DataFrame:
    found = P.scan_first_match(_text(), ["password", "AKIA[0-9A-Z]{16}", "begin rsa"])
    return t.probed.select("doc_id", found.alias("r")).select("doc_id", "r.decision", "r.score", "r.reason")


# --- secrets ---------------------------------------------------------------------------------------------------------

_RUN40 = f"list_filter({I.every('text', '[A-Za-z0-9/+=]+')}, lambda r: length(r) = 40)"


def _secret_list(name: str, pattern: str) -> str:
    if name == "aws_secret_access_key":
        return _RUN40
    return I.every("flat", pattern.replace("(?P<VAL>", "("), 1)


_PEM_SQL = r"-----BEGIN [^-\r\n]+? KEY-----[\s\S]+?-----END [^-\r\n]+? KEY-----"
_ENTROPY = "list_aggregate(string_split({c}, ''), 'entropy')"
_SHAPE64 = f"regexp_matches(c, '{C.BASE64_SHAPE}')"
_HIGH = (f"list_filter({I.every('text', C.ENTROPY_CANDIDATE)}, lambda c: length(c) >= 24 AND "
         f"{_ENTROPY.format(c='c')} >= CASE WHEN {_SHAPE64} THEN 4.3 ELSE 4.0 END)")


@query(f"""WITH {I.FLAT}, c AS (SELECT doc_id,
    {" + ".join(f"len({_secret_list(n, p)})" for n, p in C.KNOWN_TOKENS)} AS known, len({_HIGH}) AS entropy,
    len({I.every('text', _PEM_SQL)}) AS pem, len({I.every('flat', C.JWT)}) AS jwt FROM flat)
  SELECT doc_id, known::INT AS known, entropy::INT AS entropy, pem::INT AS pem, jwt::INT AS jwt, (known + entropy + pem + jwt)::INT AS total_spans FROM c""")
def detect_secrets(t: Tables) -> DataFrame:
    return t.probed.select("doc_id", K.finding_counts(K.secret_spans(_text())).alias("c")).select("doc_id", "c.*")


def _labelled(name: str, pattern: str) -> str:
    return f"SELECT doc_id, '{name}' AS label, unnest({_secret_list(name, pattern)}) AS v FROM flat"


@query(f"""WITH {I.FLAT}, f AS ({" UNION ALL ".join(_labelled(n, p) for n, p in C.KNOWN_TOKENS)}
    UNION ALL SELECT doc_id, 'high_entropy', unnest({_HIGH}) FROM flat)
  SELECT doc_id, label, left(v, 30) || CASE WHEN length(v) > 30 THEN '...' ELSE '' END AS match FROM f
  UNION ALL SELECT doc_id, 'jwt', left(v, 30) || '...' FROM (SELECT doc_id, unnest({I.every('flat', C.JWT)}) AS v FROM flat)
  UNION ALL SELECT doc_id, 'pem_key_block', left(v, 30) || '...' FROM (SELECT doc_id, unnest({I.every('text', _PEM_SQL)}) AS v FROM flat)""")
def union_findings(t: Tables) -> DataFrame:
    found = K.findings(_text(), K.secret_spans(_text()))
    return unnest(t.probed, ["doc_id"], found, "label").select("doc_id", "label", "match")


@query(f"""WITH {I.FLAT}, f AS ({" UNION ALL ".join(_labelled(n, p) for n, p in C.KNOWN_TOKENS)}
    UNION ALL SELECT doc_id, 'high_entropy', unnest({_HIGH}) FROM flat
    UNION ALL SELECT doc_id, 'jwt', unnest({I.every('flat', C.JWT)}) FROM flat
    UNION ALL SELECT doc_id, 'pem_key_block', unnest({I.every('text', _PEM_SQL)}) FROM flat)
  SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM f GROUP BY label""")
def finding_counts(t: Tables) -> DataFrame:
    # Counts per text first, in the text's row; only (label, n) pairs meet in the shuffle.
    spans = t.probed.select(K.secret_spans(_text()).alias("s"))
    labels = F.transform(F.col("s"), lambda s: s["type"])
    counts = F.transform(F.array_distinct(labels), lambda k: F.struct(
        k.alias("label"), F.size(F.filter(labels, lambda x: x == k)).alias("n")))
    per_text = unnest(spans, [], counts, "label")
    return per_text.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"""WITH {I.PROBED} SELECT doc_id, s::INT AS start, (s + length(v))::INT AS "end", v AS value, round({_ENTROPY.format(c='v')}, 6) AS bits
  FROM {I.spans_sql('probed', 'text', C.ENTROPY_CANDIDATE)} WHERE length(v) >= 24
    AND {_ENTROPY.format(c='v')} >= CASE WHEN regexp_matches(v, '{C.BASE64_SHAPE}') THEN 4.3 ELSE 4.0 END""")
def detect_high_entropy(t: Tables) -> DataFrame:
    return unnest(t.probed, ["doc_id"], K.high_entropy_spans(_text()), "start").select(
        "doc_id", "start", "end", "value", F.round(X.shannon_entropy(F.col("value")), 6).alias("bits"))


_RUN_HEX32 = (f"list_filter({I.every('text', '[A-Za-z0-9]+')}, lambda r: length(r) = 32 AND regexp_matches(r, '^[0-9a-fA-F]+$'))")


def _cloud_list(name: str, rule: str) -> str:
    if name == "PEM 패턴":
        return I.every("text", _PEM_SQL)
    if name == "aws_secret_access_key":
        return _RUN40
    if name == "twilio_auth_token":
        return _RUN_HEX32
    source = "text" if name == "candidate" else "flat"
    group = 1 if "?P<" in rule else 0
    return I.every(source, rule.replace("?P<VAL>", "").replace("?P<CREDS>", ""), group)


@query(f"""WITH {I.FLAT}, f AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, unnest({_cloud_list(n, r)}) AS v FROM flat" for n, r, *_ in C.CLOUD_RULES)})
  SELECT doc_id, rule, count(*) AS n, min(v) AS first_value FROM f GROUP BY doc_id, rule""")
def detect_cloud_secrets(t: Tables) -> DataFrame:
    spans = unnest(t.probed, ["doc_id"], K.cloud_secret_spans(_text()), "start")
    return spans.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"))


# --- obfuscation -----------------------------------------------------------------------------------------------------

_DOTTED = f"regexp_replace(text, '{C.DOT_WORDS}', '.', 'g')"
_NORMAL = f"{I.PROBED}, norm AS (SELECT doc_id, {_DOTTED} AS text FROM probed)"
_MAIL_MASKED = f"regexp_replace(text, {I.lit(I.OBFUSCATED_EMAIL_SQL)}, '\\1[MASKING]', 'g')"


@query(f"""WITH {_NORMAL} SELECT doc_id, md5(text) AS digest, length(text)::INT AS n FROM norm""")
def normalize_obfuscation(t: Tables) -> DataFrame:
    out = t.probed.select("doc_id", X.normalize_obfuscation(_text()).alias("text"))
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query(f"""WITH {I.PROBED} SELECT doc_id, md5(translate(text, '{C.HANGUL_NUMERALS}', '{C.ASCII_NUMERALS}')) AS digest FROM probed""")
def hangul_digits(t: Tables) -> DataFrame:
    return t.probed.select("doc_id", F.md5(X.hangul_digits(_text())).alias("digest"))


@query(f"""WITH {_NORMAL} SELECT doc_id, len({I.every('text', I.OBFUSCATED_EMAIL_SQL)})::INT AS n, md5({_MAIL_MASKED}) AS digest FROM norm""")
def detect_obfuscated_email(t: Tables) -> DataFrame:
    norm = t.probed.select("doc_id", X.normalize_obfuscation(_text()).alias("text"))
    return norm.select("doc_id", O.count_email(_text()).alias("n"), F.md5(O.mask_email(_text())).alias("digest"))


_ASCII_NUM = f"translate(v, '{C.HANGUL_NUMERALS}', '{C.ASCII_NUMERALS}')"
_DIGITS = f"regexp_replace({_ASCII_NUM}, '[^0-9]', '', 'g')"


def _blocks_sql(source: str) -> str:
    return f"""(SELECT doc_id, s, e, v, digits, CASE WHEN length(digits) >= 10 AND regexp_matches(ctx, '{C.BANK_WORDS}') THEN 'account'
        WHEN regexp_matches({_ASCII_NUM}, '{C.PHONE_HINT}') OR length(digits) BETWEEN 10 AND 12 THEN 'phone' ELSE 'none' END AS kind
      FROM (SELECT b.*, s + length(v) AS e, {_DIGITS} AS digits,
              substring(d.text, CAST(greatest(s - 16, 0) + 1 AS BIGINT), CAST(s + length(v) + 16 - greatest(s - 16, 0) AS BIGINT)) AS ctx
            FROM {I.spans_sql(source, 'text', C.NUMBER_BLOCK)} b JOIN {source} d USING (doc_id)))"""


@query(f"""WITH {_NORMAL} SELECT doc_id, s::INT AS start, e::INT AS "end", kind, digits FROM {_blocks_sql('norm')}""")
def classify_number_blocks(t: Tables) -> DataFrame:
    norm = t.probed.select("doc_id", X.normalize_obfuscation(_text()).alias("text"))
    return unnest(norm, ["doc_id"], O.number_blocks(_text()), "start").drop("phone_like")


def _address_chain(c: str) -> str:
    for p in C.OBFUSCATED_ADDRESSES:
        c = f"regexp_replace({c}, {I.lit(p)}, '[MASKING]', 'g')"
    return c


def _address_count(c: str) -> str:
    counts = []
    for p in C.OBFUSCATED_ADDRESSES:
        counts.append(f"len({I.every(c, p)})")
        c = f"regexp_replace({c}, {I.lit(p)}, '[MASKING]', 'g')"
    return " + ".join(counts)


@query(f"""WITH {I.PROBED} SELECT doc_id, ({_address_count('text')})::INT AS n, md5({_address_chain('text')}) AS digest FROM probed""")
def detect_address(t: Tables) -> DataFrame:
    return t.probed.select("doc_id", O.masked_addresses(_text()).alias("a")).select("doc_id", F.col("a.n").alias("n"), F.md5("a.text").alias("digest"))


_NUMBERS_MASKED = f"""mailed AS (SELECT doc_id, {_MAIL_MASKED} AS text, len({I.every('text', I.OBFUSCATED_EMAIL_SQL)}) AS email FROM norm),
blocks AS (SELECT * FROM {_blocks_sql('mailed')}),
risky AS (SELECT doc_id, list(struct_pack(s := s, e := e) ORDER BY s) AS rs, count(*) FILTER (kind = 'phone') AS phone,
           count(*) FILTER (kind = 'account') AS account FROM blocks WHERE kind <> 'none' GROUP BY doc_id),
numbered AS (SELECT m.doc_id, email, coalesce(phone, 0) AS phone, coalesce(account, 0) AS account, CASE WHEN rs IS NULL THEN text ELSE
    array_to_string(list_transform(range(1, len(rs) + 1), lambda i: substring(text, CAST(CASE WHEN i = 1 THEN 0 ELSE rs[i-1].e END + 1 AS BIGINT),
      CAST(rs[i].s - CASE WHEN i = 1 THEN 0 ELSE rs[i-1].e END AS BIGINT)) || '[MASKING]'), '') || substring(text, CAST(rs[len(rs)].e + 1 AS BIGINT)) END AS text
  FROM mailed m LEFT JOIN risky USING (doc_id))"""


def _mask_all(t: Tables) -> DataFrame:
    """normalise, e-mail, numbers, addresses; each step on the text the step before left."""
    norm = t.probed.select("doc_id", X.normalize_obfuscation(_text()).alias("text"))
    mailed = norm.select("doc_id", O.count_email(_text()).alias("email"), O.mask_email(_text()).alias("text"))
    blocks = mailed.withColumn("b", O.number_blocks(_text()))
    numbered = blocks.select(
        "doc_id", "email", O.count_kind(F.col("b"), "phone").alias("phone"), O.count_kind(F.col("b"), "account").alias("account"),
        O.mask_numbers(_text(), F.col("b")).alias("text"))
    addressed = numbered.select("doc_id", "phone", "email", "account", O.masked_addresses(_text()).alias("a"))
    return addressed.select("doc_id", "phone", "email", "account", F.col("a.n").alias("address"), F.col("a.text").alias("masked"))


@query(f"""WITH {_NORMAL}, {_NUMBERS_MASKED} SELECT doc_id, phone::INT AS phone, email::INT AS email, account::INT AS account,
  ({_address_count('text')})::INT AS address, md5({_address_chain('text')}) AS digest FROM numbered""")
def mask_pii_obfuscated(t: Tables) -> DataFrame:
    return _mask_all(t).select("doc_id", "phone", "email", "account", "address", F.md5("masked").alias("digest"))


@query(f"""WITH {_NORMAL}, {_NUMBERS_MASKED}, c AS (SELECT phone, email, account, ({_address_count('text')}) AS address FROM numbered)
  SELECT sum(phone)::BIGINT AS phone, sum(email)::BIGINT AS email, sum(account)::BIGINT AS account, sum(address)::BIGINT AS address FROM c""")
def mask_stats(t: Tables) -> DataFrame:
    return _mask_all(t).agg(*[F.sum(c).alias(c) for c in ("phone", "email", "account", "address")])


_FIRST_MAIL = f"(replace(list_extract({I.every('text', I.OBFUSCATED_EMAIL_SQL, 2)}, 1), ' ', ''))"


@query(f"""WITH {_NORMAL}, m AS (SELECT doc_id, {_FIRST_MAIL} AS mail FROM norm),
  b AS (SELECT doc_id, min_by(digits, s) FILTER (kind = 'account') AS acc,
          min_by(digits, s) FILTER (regexp_matches({_ASCII_NUM}, '{C.PHONE_HINT}') OR length(digits) BETWEEN 10 AND 12) AS ph
        FROM {_blocks_sql('norm')} GROUP BY doc_id),
  p AS (SELECT m.doc_id, split_part(mail, '@', 1) AS loc, mail, acc, ph FROM m LEFT JOIN b USING (doc_id))
  SELECT doc_id, nullif(concat_ws(', ',
    CASE WHEN mail IS NOT NULL THEN left(loc, CASE WHEN length(loc) <= 2 THEN 1 ELSE 2 END) || repeat('*', length(loc) - CASE WHEN length(loc) <= 2 THEN 1 ELSE 2 END) || '@' || substring(mail, position('@' IN mail) + 1) END,
    CASE WHEN acc IS NOT NULL THEN left(acc, 3) || '.' || repeat('*', greatest(length(acc) - 7, 0)) || '.' || right(acc, 4) END,
    CASE WHEN ph IS NULL THEN NULL WHEN length(ph) >= 7 THEN left(ph, 3) || '.****.' || right(ph, 4) ELSE '[PHONE]' END), '') AS samples FROM p""")
def partial_samples(t: Tables) -> DataFrame:
    norm = t.probed.select("doc_id", X.normalize_obfuscation(_text()).alias("text"))
    wanted = F.array(F.lit("email"), F.lit("account"), F.lit("phone"))
    return norm.select("doc_id", O.partial_samples(_text(), wanted).alias("samples"))


# --- code ------------------------------------------------------------------------------------------------------------

_TRIM = "trim({c}, ' ' || chr(10) || chr(9) || chr(13))"
_BLOCKS = f"""blocks AS (SELECT doc_id, i::INT AS pos, CASE WHEN ls[i] = '' OR ls[i] IS NULL THEN 'plaintext' ELSE ls[i] END AS lang, {_TRIM.format(c='cs[i]')} AS code
  FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT doc_id, {I.every('text', C.FENCED_CODE, 1)} AS ls, {I.every('text', C.FENCED_CODE, 2)} AS cs FROM probed)))"""
_SEVERITY = "least((" + " + ".join(f"CASE WHEN regexp_matches(code, {I.lit(p)}) THEN 1 ELSE 0 END" for p in C.RISKY_CODE) + ") / 7.0, 1.0)"


@query(f"""WITH {I.PROBED}, {_BLOCKS} SELECT doc_id, pos, lang, md5(code) AS digest FROM blocks""")
def extract_code_blocks(t: Tables) -> DataFrame:
    return t.probed.select("doc_id", F.posexplode(D.extract_code_blocks(_text())).alias("i", "b")).select(
        "doc_id", (F.col("i") + 1).alias("pos"), "b.lang", F.md5("b.code").alias("digest"))


@query(f"""WITH {I.PROBED}, {_BLOCKS} SELECT doc_id, pos, lang, round({_SEVERITY}, 6)::DOUBLE AS severity FROM blocks""")
def score_code_risk(t: Tables) -> DataFrame:
    scored = D.score_code_risk(D.extract_code_blocks(_text()))
    return t.probed.select("doc_id", F.posexplode(scored).alias("i", "f")).select(
        "doc_id", (F.col("i") + 1).alias("pos"), "f.lang", F.round("f.severity", 6).alias("severity"))


_ALL_BLOCKS = f"""{_BLOCKS}, units AS (SELECT doc_id, code FROM blocks UNION ALL SELECT doc_id, text FROM probed p WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = p.doc_id)),
scored AS (SELECT doc_id, count(*) AS n, max({_SEVERITY}) AS worst FROM units GROUP BY doc_id)"""


@query(f"""WITH {I.PROBED}, {_ALL_BLOCKS} SELECT doc_id, worst >= 0.5 AS detected, n::INT AS match_count, round(worst, 6)::DOUBLE AS worst_score,
  CASE WHEN worst >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS final_action FROM scored""")
def decide_code_risk(t: Tables) -> DataFrame:
    return t.probed.select("doc_id", D.decide_code_risk(_text()).alias("d")).select(
        "doc_id", "d.detected", "d.match_count", F.round("d.worst_score", 6).alias("worst_score"), "d.final_action")


@query(f"""WITH {I.PROBED}, {_ALL_BLOCKS} SELECT round(max(worst), 6)::DOUBLE AS worst, sum(n)::BIGINT AS n, bool_or(worst >= 0.5) AS has_issue FROM scored""")
def worst_score(t: Tables) -> DataFrame:
    per_text = t.probed.select(D.decide_code_risk(_text()).alias("d"))
    return per_text.agg(F.round(F.max("d.worst_score"), 6).alias("worst"), F.sum("d.match_count").alias("n"), F.bool_or("d.detected").alias("has_issue"))


@query(f"""WITH {I.PROBED}, {_BLOCKS}, s AS (SELECT *, {_SEVERITY} AS sev FROM blocks)
  SELECT doc_id, '<details>' || chr(10) || '<summary>code scan</summary>' || chr(10) || chr(10) || chr(10) || '{C.REPORT_COLUMNS}' || chr(10) || '{C.REPORT_RULE}' || chr(10)
    || string_agg('| ' || pos || ' | `' || lang || '` | `' || CASE WHEN sev >= 0.5 THEN 'block' ELSE 'allow' END || '` | ' || printf('%.2f', round(sev::DOUBLE, 2)) || ' | risk |', chr(10) ORDER BY pos)
    || chr(10) || chr(10) || '</details>' AS report, bool_or(sev >= 0.5) AS has_issue FROM s GROUP BY doc_id""")
def code_scan_report(t: Tables) -> DataFrame:
    scored = t.probed.select("doc_id", D.score_code_risk(D.extract_code_blocks(_text())).alias("s")).where(F.size("s") > 0)
    findings = scored.select("doc_id", F.transform("s", lambda f: F.struct(
        f["lang"].alias("lang"), F.when(f["severity"] >= 0.5, "block").otherwise("allow").alias("decision"),
        F.round(f["severity"], 2).alias("score"), F.lit("risk").alias("reason"))).alias("f"))
    return findings.select("doc_id", D.code_scan_report(F.col("f")).alias("report"), D.report_verdict(F.col("f"))["has_issue"].alias("has_issue"))


