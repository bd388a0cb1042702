"""Inputs derived from the given tables, written in SQL that Spark and the SQL checker both understand."""

from __future__ import annotations

from sieveline.functions import catalog as C


def _pad(n: int, times: int = 1) -> str:
    """Digits of the document id, so that every document carries other values."""
    return f"lpad(CAST((doc_id * {times}) % {10 ** n} AS STRING), {n}, '0')"


_NL = "chr(10)"
# One passage per document, by id. Several use a place where a digit follows a Hangul letter (no word boundary).
PASSAGES = (
    f"' tel 010-1234-' || {_pad(4)} || ' and kim.lee+x' || {_pad(3)} || '@example.co.kr, bye'",
    f"' 번호010-1234-' || {_pad(4)} || ' call 02-345-' || {_pad(4, 7)} || ' or 02-345-' || {_pad(4, 3)} || '.'",
    f"' id 900101-1' || {_pad(6, 13)} || ' passport M' || {_pad(8, 11)} || ' end'",
    f"' id 900101-5' || {_pad(6, 17)} || ' ip 10.20.' || CAST(doc_id % 250 AS STRING) || '.7 end'",
    f"' licence 11-22-' || {_pad(6)} || '-33 firm 123-45-' || {_pad(5)} || ' end'",
    f"' NHIS: 1' || {_pad(9)} || ' TIN: 12-' || {_pad(7)} || ' army 21-' || {_pad(8)} || ' end'",
    "' 주소 대구광역시 수성구 들안로 ' || CAST(doc_id % 500 + 1 AS STRING) || ' 입니다'",
    "' 주소 충청남도 아산시 배방동 ' || CAST(doc_id % 300 + 1 AS STRING) || '번지 (31456) 울산광역시 남구 달동 '"
    " || CAST(doc_id % 90 + 1 AS STRING) || ' 입니다'",
    "' card 4111 1111 1111 1111 and 4000-0000-0000-' || " + _pad(4) + " || ' end'",
    f"' card 4000-0000-0000-' || {_pad(4, 9)} || ' end'",
    f"{_NL} || 'api_key = \"k' || {_pad(12)} || '\"' || {_NL} || 'token ghp_' || lpad(CAST(doc_id AS STRING), 36, 'aB3') || ' end'",
    f"' key AKIA' || {_pad(16)} || ' stripe sk_live_' || {_pad(18)} || ' xoxb-' || {_pad(12)} || ' end'",
    f"' jwt eyJhbGciOiJI.eyJzdWIiOiIx' || {_pad(6)} || '.c2lnbmF0dXJl end'",
    f"{_NL} || '-----BEGIN RSA PRIVATE KEY-----' || {_NL} || 'MIIE' || {_pad(8)} || {_NL} || '-----END RSA PRIVATE KEY-----'",
    f"{_NL} || '```python' || {_NL} || 'import os' || {_NL} || 'os.system(cmd) # ' || CAST(doc_id AS STRING) || {_NL}"
    f" || 'eval(x); exec(y); open(z)' || {_NL} || '```' || {_NL} || '```' || {_NL} || 'print(1)' || {_NL} || '```'",
    f"' password: hunter' || {_pad(6)} || ' bank account 620-118-' || {_pad(6)} || ' kim@example 점 com end'",
    f"' 번호는 공일육.이칠팔오.삼육일' || CAST(doc_id % 10 AS STRING) || ' +82 16 2222 ' || {_pad(4)} || ' end'",
    f"' conn DefaultEndpointsProtocol=https;AccountName=acc;AccountKey=' || lpad(CAST(doc_id AS STRING), 44, 'qR7')"
    f" || ' http://bob:pw' || {_pad(3)} || '@db.example.com/x end'",
    f"' mail ann' || {_pad(3)} || '@example.com bob' || {_pad(3)} || '@example.org ann' || {_pad(3)} || '@example.com end'",
    "''",
)
PROBE = f"(CASE doc_id % {len(PASSAGES)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PASSAGES)) + " END)"

# --- SQL twin building blocks ----------------------------------------------------------------------------------------

PROBED = f"probed AS (SELECT doc_id, lang, source, text || {PROBE} AS text FROM documents)"


def flat(c: str) -> str:
    """Text of equal length in which every non-ASCII letter is an ASCII word character.

    The checker's regex engine knows word boundaries for ASCII only; on the flattened text they are where Unicode-aware
    boundaries are on the original.
    """
    return (f"regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')")


FLAT = f"{PROBED}, flat AS (SELECT *, {flat('text')} AS flat FROM probed)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def every(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, {lit(pattern)}, {group})"


def distinct_in_order(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


# Patterns without look-around for the checker; group 1 is the value.
EMAIL_SQL = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})(?:$|\s|[<>,;:)\]]|[^\x00-\x7F])"
WORD = r"[\p{L}\p{N}_]"
OBFUSCATED_EMAIL_SQL = (r"(?i)(^|[^\p{L}\p{N}_])([\p{L}\p{N}_][\p{L}\p{N}_.+-]{0,63}\s*@\s*(?:[\p{L}\p{N}_-]{1,63}"
                        r"(?:점|닷|도트|\.)){1,4}[\p{L}\p{N}_-]{2,24}\b)")
PII_SQL: dict[str, list[tuple[str, str, int]]] = {
    "email": [("text", EMAIL_SQL, 1)],
    "phone": [("flat", C.KR_MOBILE, 0), ("flat", C.KR_PHONE, 0)],
    "passport": [("flat", C.PASSPORT, 0)],
    "kr_rrn": [("flat", C.KR_RRN, 0)],
    "ip": [("flat", C.IP, 0)],
    "driver_license": [("flat", C.DRIVER_LICENSE, 0)],
    "foreign_rrn": [("flat", C.FOREIGN_RRN, 0)],
    "business_reg": [("flat", C.BUSINESS_REG, 0)],
    "health_insurance": [("text", C.HEALTH_INSURANCE, 0)],
    "tax_info": [("text", C.TAX_INFO, 0)],
    "military_id": [("flat", C.MILITARY_ID, 0)],
    "address": [("text", C.ADDRESS_ROAD, 0), ("text", C.ADDRESS_POSTAL, 0), ("text", C.ADDRESS_SIMPLE, 0),
                ("text", C.ADDRESS_BUILDING, 0)],
}


def luhn(d: str) -> str:
    """Luhn test over a string of digits."""
    digit = f"CAST(substring({d}, CAST(i AS INT), 1) AS INT)"
    return (f"(length({d}) > 0 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN "
            f"(length({d}) - i) % 2 = 1 THEN CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END "
            f"ELSE {digit} END)) % 10 = 0)")


def _hits_of(type_: str, sources: list[tuple[str, str, int]]) -> str:
    xs = [every(c, p, g) for c, p, g in sources]
    if type_ == "address":
        xs = [f"list_transform({x}, lambda v: trim(v))" for x in xs]
    joined = xs[0]
    for x in xs[1:]:
        joined = f"list_concat({joined}, {x})"
    return f"SELECT doc_id, lang, '{type_}' AS type, {joined} AS xs FROM flat"


CARDS = f"""cards AS (
  SELECT doc_id, lang, list_filter({every('flat', C.CARD)},
           lambda c: length(regexp_replace(c, '\\D', '', 'g')) BETWEEN 13 AND 19) AS cs FROM flat),
card_hits AS (
  SELECT doc_id, lang, cs, list_filter(cs, lambda c: {luhn("regexp_replace(c, '\\D', '', 'g')")}) AS ok FROM cards)"""

HITS = f"""{FLAT}, {CARDS}, found AS (
  {" UNION ALL ".join(_hits_of(t, s) for t, s in PII_SQL.items())}
  UNION ALL SELECT doc_id, lang, 'credit_card', ok[1:1] FROM card_hits
  UNION ALL SELECT doc_id, lang, 'credit_card_candidate', CASE WHEN len(ok) = 0 THEN cs ELSE [] END FROM card_hits),
hits AS (SELECT doc_id, lang, type, {distinct_in_order('xs')} AS vals FROM found WHERE len(xs) > 0)"""


def spans_sql(source: str, c: str, pattern: str, group: int = 0, keys: str = "doc_id") -> str:
    """Offsets of matches: pieces between matches and matches interleave."""
    return f"""(SELECT {keys}, i - 1 AS ordinal,
      list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS s,
      vs[i] AS v
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT {keys}, {every(c, pattern)} AS ms, {every(c, pattern, group)} AS vs,
             string_split_regex({c}, {lit(pattern)}) AS ps FROM {source}) WHERE len(ms) > 0))"""


# --- other derived inputs --------------------------------------------------------------------------------------------

REQUEST = """doc_id, 'm-' || CAST(doc_id AS STRING) AS message_id, 's-' || CAST(doc_id % 97 AS STRING) AS session_id,
  'user' || CAST(doc_id % 50 AS STRING) AS user_id, 'user' || CAST(doc_id % 50 AS STRING) || '@example.com' AS email,
  CAST(doc_id % 6 AS INT) AS ai_service, '10.0.0.' || CAST(doc_id % 250 AS STRING) AS client_host"""

# JSON bodies of the shapes model APIs answer with
RESPONSE_JSON = """(CASE doc_id % 10
  WHEN 0 THEN '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a' || CAST(doc_id AS STRING) || '"},{"role":"user","content":"z"}]}'
  WHEN 1 THEN '{"messages":[{"role":"model","content":"m' || CAST(doc_id AS STRING) || '"}],"choices":[{"text":"no"}]}'
  WHEN 2 THEN '{"messages":[{"role":"assistant","content":""}],"choices":[{"message":{"content":"c' || CAST(doc_id AS STRING) || '"}}]}'
  WHEN 3 THEN '{"choices":[{"message":{},"text":"t' || CAST(doc_id AS STRING) || '"}]}'
  WHEN 4 THEN '{"response":"r' || CAST(doc_id AS STRING) || '"}'
  WHEN 5 THEN '{"output":{"content":"o' || CAST(doc_id AS STRING) || '"}}'
  WHEN 6 THEN '{"result":"","assistant":"s' || CAST(doc_id AS STRING) || '"}'
  WHEN 7 THEN '{"choices":[]}'
  WHEN 8 THEN 'not json'
  ELSE '{"response":5}' END)"""
RESPONSE_TEXT = """CASE doc_id % 10 WHEN 0 THEN 'a' || CAST(doc_id AS STRING) WHEN 1 THEN 'm' || CAST(doc_id AS STRING)
  WHEN 2 THEN 'c' || CAST(doc_id AS STRING) WHEN 3 THEN 't' || CAST(doc_id AS STRING) WHEN 4 THEN 'r' || CAST(doc_id AS STRING)
  WHEN 5 THEN 'o' || CAST(doc_id AS STRING) WHEN 6 THEN 's' || CAST(doc_id AS STRING) END"""

SESSION_JSON = """(CASE doc_id % 9
  WHEN 0 THEN '{"metadata":{"__sid":"a' || CAST(doc_id AS STRING) || '","session_id":"no"}}'
  WHEN 1 THEN '{"metadata":{"__sid":"","session_id":"b' || CAST(doc_id AS STRING) || '","chat_id":"no"},"channel":"app"}'
  WHEN 2 THEN '{"metadata":{"thread_id":"c' || CAST(doc_id AS STRING) || '","channel":"mail"},"channel":"app"}'
  WHEN 3 THEN '{"session":{"id":"d' || CAST(doc_id AS STRING) || '"},"client_ip":"1.1.1.1"}'
  WHEN 4 THEN '{"conversation":{"id":"e' || CAST(doc_id AS STRING) || '"},"session_id":"no","src_ip":"2.2.2.2"}'
  WHEN 5 THEN '{"session_id":"f' || CAST(doc_id AS STRING) || '","ip":"3.3.3.3","src_ip":""}'
  WHEN 6 THEN '{"_filters":{"inlet":{"__sid":"g' || CAST(doc_id AS STRING) || '"}},"request":{"ip":"4.4.4.4"}}'
  WHEN 7 THEN '{"metadata":{"channel":"app"}}'
  ELSE '{}' END)"""

VERDICT_RAW = """(CASE doc_id % 9
  WHEN 0 THEN '{"decision":"allow","reasons":[]}'
  WHEN 1 THEN '{"decision":"BLOCK","reasons":["phone_number","email_address","phone_number"]}'
  WHEN 2 THEN 'json: {"decision":"block","reasons":["card' || CAST(doc_id % 7 AS STRING) || '"]}'
  WHEN 3 THEN '{"decision":"maybe","reasons":["unsure"]}'
  WHEN 4 THEN '{"decision":"block","reasons":["a","b",],}'
  WHEN 5 THEN 'I think: {"decision":"allow","reasons":["public"]} done'
  WHEN 6 THEN ''
  WHEN 7 THEN 'garbage ' || CAST(doc_id AS STRING)
  ELSE '{''decision'': ''block'', ''reasons'': [''address'']}' END)"""

SAFETY_RAW = """(CASE doc_id % 6
  WHEN 0 THEN '{"choices":[{"message":{"content":"Safety: Safe; Categories: None"}}]}'
  WHEN 1 THEN '{"choices":[{"message":{"content":"Safety: Unsafe; Categories: PII"}}]}'
  WHEN 2 THEN '{"choices":[{"message":{"content":"safety: unsafe"}}]}'
  WHEN 3 THEN '{"choices":[]}' WHEN 4 THEN '' ELSE 'not json' END)"""
