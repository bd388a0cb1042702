"""Rule queries: matching, plans, span algebra, redaction, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import pii as P
from sieveline.functions import spans as S
from sieveline.functions.expr import unnest, unnest_map
from sieveline.operators import intervals, rules as R
from sieveline.operators.decisions import rule_filter
from sieveline.operators import lines as L
from sieveline.plans import inputs as I
from sieveline.plans.policy import _items as _top_level
from sieveline.plans.registry import Tables, query
from sieveline.sources import readers

# The three rules of the sample export: (name, rule, action, flags, group)
EXPORT_RULES = (("KR_RRN", C.KR_RRN, "masking", 0, None), ("KR_PHONE", C.KR_PHONE, "block", 0, None), ("EMAIL", C.EMAIL, "accept", 0, None))
RULES = R.as_rules(EXPORT_RULES)
RRN, PHONE = C.KR_RRN, C.KR_PHONE


def _text() -> Column:
    return F.col("text")


def _hits_sql() -> str:
    """Hits of the three rules with offsets; e-mail is found with its following character, which is then left off."""
    email_full = I.spans_sql("flat", "text", I.EMAIL_SQL, 1)
    return f"""rule_hits AS (
      SELECT doc_id, 0 AS ord, 'KR_RRN' AS rule, ordinal, s, v FROM {I.spans_sql('flat', 'flat', RRN)}
      UNION ALL SELECT doc_id, 1, 'KR_PHONE', ordinal, s, v FROM {I.spans_sql('flat', 'flat', PHONE)}
      UNION ALL SELECT doc_id, 2, 'EMAIL', ordinal, s, v FROM {email_full})"""


@query(f"""WITH {I.FLAT}, {_hits_sql()} SELECT doc_id, ord::INT AS ord, rule, ordinal::INT AS ordinal, s::INT AS start, (s + length(v))::INT AS "end", v AS value FROM rule_hits""")
def detect_rules(t: Tables) -> DataFrame:
    return R.detect_rules(t.probed, ["doc_id"], "text", RULES)


@query(f"""WITH {I.FLAT}, {_hits_sql()} SELECT DISTINCT doc_id, ord::INT AS ord, rule AS name, CASE rule WHEN 'KR_RRN' THEN 'masking' WHEN 'KR_PHONE' THEN 'block' ELSE 'accept' END AS action FROM rule_hits""")
def join_text_rules(t: Tables) -> DataFrame:
    return R.join_text_rules(t.probed, ["doc_id"], "text", RULES).select("doc_id", "ord", "name", "action")


_MASKED = (f"regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}_])([0-9]{{6}})-?([1-4][0-9]{{6}})\\b', '\\1[KR_RRN]', 'g'), "
           f"'(^|[^\\p{{L}}\\p{{N}}_])(0\\d{{1,2}}-\\d{{3,4}}-\\d{{4}}\\b)', '\\1[KR_PHONE]', 'g'), "
           f"'[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}($|\\s|[<>,;:)\\]]|[^\\x00-\\x7F])', '[EMAIL]\\1', 'g')")


@query(f"""WITH {I.FLAT}, {_hits_sql()}, g AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT lower(rule), ',') AS types FROM rule_hits GROUP BY doc_id)
  SELECT p.doc_id, CASE WHEN n > 0 THEN 'FLAG' ELSE 'ALLOW' END AS decision, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
    CASE WHEN n > 0 THEN 'pii detected' ELSE 'no match' END AS reason, coalesce(n, 0)::INT AS n_spans,
    coalesce(array_to_string(list_sort(string_split(types, ',')), ','), '') AS types, md5({_MASKED}) AS digest FROM probed p LEFT JOIN g USING (doc_id)""")
def detect_plan(t: Tables) -> DataFrame:
    plan = t.probed.select("doc_id", "text", R.detect_plan(_text(), RULES).alias("p"))
    return plan.select("doc_id", "p.decision", "p.score", "p.reason", F.size("p.spans_all").alias("n_spans"),
                       F.array_join(F.array_sort(F.map_keys("p.values_by_type")), ",").alias("types"),
                       F.md5(S.apply_replacements(_text(), F.col("p.replacements"))).alias("digest"))


@query(f"""WITH {I.FLAT}, {_hits_sql()}, g AS (SELECT doc_id, count(*) AS n FROM rule_hits GROUP BY doc_id)
  SELECT p.doc_id, CASE WHEN n > 0 THEN 'FLAG' ELSE 'ALLOW' END AS plan_decision, CASE WHEN n > 0 THEN 'masking' ELSE 'allow' END AS action, md5({_MASKED}) AS digest
  FROM probed p LEFT JOIN g USING (doc_id)""")
def load_regex_action(t: Tables) -> DataFrame:
    out = rule_filter(t.probed, "text", RULES, policy="masking")
    return out.select("doc_id", "plan_decision", "action", F.md5("content").alias("digest"))


@query(f"""WITH {I.FLAT}, {_hits_sql()} SELECT doc_id, lower(rule) AS type, count(DISTINCT v)::INT AS n, min(v) AS smallest FROM rule_hits GROUP BY doc_id, lower(rule)""")
def values_by_type(t: Tables) -> DataFrame:
    spans = unnest_map(t.probed, ["doc_id"], S.values_by_type(R.rule_spans(_text(), RULES)), "type", "v")
    return spans.select("doc_id", "type", F.size("v").alias("n"), F.array_min("v").alias("smallest"))


@query(f"""WITH {I.FLAT}, {_hits_sql()} SELECT DISTINCT doc_id, rule, v AS value FROM rule_hits""")
def distinct_values(t: Tables) -> DataFrame:
    # Distinct inside the text's row first; nothing is left to do across rows.
    spans = R.rule_spans(_text(), RULES)
    pairs = F.array_distinct(F.transform(spans, lambda s: F.struct(s["rule"].alias("rule"), s["value"].alias("value"))))
    return unnest(t.probed, ["doc_id"], pairs, "rule")


@query(f"""WITH {I.FLAT}, {_hits_sql()} SELECT doc_id, min_by(rule, ord * 1000000 + s) AS rule, min_by(v, ord * 1000000 + s) AS value FROM rule_hits GROUP BY doc_id""")
def first_hit_per_text(t: Tables) -> DataFrame:
    hits = R.detect_rules(t.probed, ["doc_id"], "text", RULES).withColumn("at", F.struct("ord", "start"))
    return R.first_hit_per_text(hits, "doc_id", "at", "rule", "value")


@query(f"""WITH {I.FLAT}, {_hits_sql()}, f AS (SELECT doc_id, min(ord) AS o FROM rule_hits GROUP BY doc_id)
  SELECT p.doc_id, CASE o WHEN 0 THEN 'masking' WHEN 1 THEN 'block' WHEN 2 THEN 'accept' ELSE '' END AS action, coalesce(o::VARCHAR, '') AS policy_id,
    CASE o WHEN 0 THEN 'KR_RRN' WHEN 1 THEN 'KR_PHONE' WHEN 2 THEN 'EMAIL' ELSE '' END AS policy_name FROM probed p LEFT JOIN f USING (doc_id)""")
def scan_file_rules(t: Tables) -> DataFrame:
    from sieveline.operators.files import scan_file_rules as scan

    return t.probed.select("doc_id", scan(_text(), RULES).alias("r")).select("doc_id", "r.*")


@query(f"""WITH {I.PROBED} SELECT doc_id, len({I.every('text', 'AKIA[0-9]+')})::INT AS hits, CASE WHEN regexp_matches(text, 'AKIA[0-9]+') THEN 'block' ELSE 'allow' END AS action FROM probed""")
def test_rule(t: Tables) -> DataFrame:
    return R.test_rule(t.probed, ["doc_id"], "text", "AKIA[0-9]+", "block")


test_rule.__test__ = False


@query(f"""WITH {I.FLAT}, {_hits_sql()} SELECT doc_id, 'KR_RRN' AS name, 'masking' AS action FROM rule_hits WHERE rule = 'KR_RRN' GROUP BY doc_id
  UNION ALL SELECT doc_id, 'hunter', 'block' FROM probed WHERE regexp_matches(text, '(?i)HUNTER[0-9]')
  UNION ALL SELECT doc_id, 'acc', 'block' FROM probed WHERE regexp_matches(text, '(?i)accountname')""")
def custom_patterns(t: Tables) -> DataFrame:
    base = t.spark.createDataFrame([(0, "r0", "KR_RRN", C.KR_RRN, "masking", 0, None)],
                                   "ord int, id string, name string, rule string, action string, regex_flag int, regex_group_val string")
    table = R.custom_patterns(base, ["HUNTER[0-9]", "accountname"])
    hits = R.join_text_rules(t.probed, ["doc_id"], "text", table)
    name = F.when(F.col("ord") == 0, F.col("name")).when(F.col("ord") == 1, "hunter").otherwise("acc")
    return hits.select("doc_id", name.alias("name"), "action")


# --- rule tables -----------------------------------------------------------------------------------------------------

_EXPORTED = """CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE ' ' || p_name || ' ' END AS name,
  CASE p_partkey % 7 WHEN 0 THEN '(open' WHEN 1 THEN '' ELSE 'part' || CAST(p_partkey AS STRING) || '[0-9]+' END AS rule, 'block' AS action,
  CASE p_partkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'Deployed' ELSE 'deployed' END AS status"""


@query("""WITH r AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 11 = 0 THEN 'UNNAMED' ELSE trim(p_name) END AS name, 'part' || p_partkey || '[0-9]+' AS rule
    FROM part WHERE p_partkey % 7 > 1 AND p_partkey % 5 > 0)
  SELECT id, name, rule, lower(name) AS type, '[' || name || ']' AS token FROM r""")
def scan_rules_json(t: Tables) -> DataFrame:
    """Rules written as exports of some hundred rules each and read back."""
    path = t.work("rule-export")
    rules = t.part.selectExpr(*_top_level(_EXPORTED), "p_partkey DIV 300 AS export")
    exports = rules.groupBy("export").agg(F.to_json(F.struct(F.lit(200).alias("statusCode"), F.collect_list(F.struct("id", "name", "rule", "action", "status")).alias("data"))).alias("value"))
    exports.write.partitionBy("export").text(path)
    return readers.scan_rules_json(t.spark, path).select("id", "name", "rule", "type", "token")


# Rules derived from the part table: usable ones, an unclosed group, an empty rule, a rule that hits empty text.
PART_RULE = """(CASE p_partkey % 7 WHEN 0 THEN 'key' || CAST(p_partkey AS STRING) || '(' WHEN 1 THEN '' WHEN 2 THEN 'x' || CAST(p_partkey AS STRING) || '|'
  ELSE 'part' || CAST(p_partkey AS STRING) || '[0-9]+' END)"""


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'bad' WHEN 1 THEN 'empty rule' WHEN 2 THEN 'matches empty text' ELSE 'ok' END AS state FROM part")
def quarantine_rules(t: Tables) -> DataFrame:
    rules = t.part.select("p_partkey", F.expr(PART_RULE).alias("rule"), F.lit(0).alias("regex_flag"))
    good, bad = R.quarantine_rules(rules)
    state = F.when(F.col("problem").startswith("does not compile"), "bad").otherwise(F.col("problem"))
    return good.select("p_partkey", F.lit("ok").alias("state")).unionByName(bad.select("p_partkey", state.alias("state")))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {PART_RULE} END AS rule, p_partkey % 5 <> 0 AS decoded FROM part""")
def decode_rule(t: Tables) -> DataFrame:
    coded = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("%%% not base64 %%%")).otherwise(
        F.base64(F.encode(F.expr(PART_RULE), "UTF-8"))).alias("rule"))
    good, bad = R.decode_rules(coded)
    return good.select("p_partkey", "rule", F.lit(True).alias("decoded")).unionByName(
        bad.select("p_partkey", F.lit(None).cast("string").alias("rule"), F.lit(False).alias("decoded")))


# --- span algebra ----------------------------------------------------------------------------------------------------

# Overlapping rules: a local part with its @, the whole address, the domain.
_OVERLAP = (("local", r"[a-z]+[0-9]{3}@"), ("address", r"[a-z]+[0-9]{3}@[a-z]+"), ("domain", r"[a-z]+\.(?:com|org|co)"))


def _overlapping() -> Column:
    return S.spans_of(_text(), [S.SpanRule(p, n, ord=i) for i, (n, p) in enumerate(_OVERLAP)])


def _overlap_sql() -> str:
    parts = [f"SELECT doc_id, {i} AS ord, '{n}' AS rule, s, s + length(v) AS e, v FROM {I.spans_sql('probed', 'text', p)}" for i, (n, p) in enumerate(_OVERLAP)]
    return f"{I.PROBED}, sp AS ({' UNION ALL '.join(parts)})"


# In this rule set every longest span is an address or a lone domain, so the greedy choice has a closed form.
@query(f"""WITH {_overlap_sql()} SELECT doc_id, rule, s::INT AS start, e::INT AS "end" FROM sp a WHERE NOT EXISTS (
    SELECT 1 FROM sp b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND (b.s < a.s OR (b.s = a.s AND b.ord < a.ord))))
      AND NOT EXISTS (SELECT 1 FROM sp c WHERE c.doc_id = b.doc_id AND c.s < b.e AND b.s < c.e AND (c.e - c.s > b.e - b.s OR (c.e - c.s = b.e - b.s AND (c.s < b.s OR (c.s = b.s AND c.ord < b.ord))))))""")
def resolve_overlaps_longest(t: Tables) -> DataFrame:
    return unnest(t.probed, ["doc_id"], S.resolve_longest(_overlapping()), "start").select("doc_id", "rule", "start", "end")


@query(f"""WITH {_overlap_sql()} SELECT doc_id, rule, s::INT AS start, e::INT AS "end" FROM sp a WHERE NOT EXISTS (
    SELECT 1 FROM sp b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e AND b.ord < a.ord
      AND NOT EXISTS (SELECT 1 FROM sp c WHERE c.doc_id = b.doc_id AND c.s < b.e AND b.s < c.e AND c.ord < b.ord))""")
def resolve_overlaps_priority(t: Tables) -> DataFrame:
    return unnest(t.probed, ["doc_id"], S.resolve_priority(_overlapping()), "start").select("doc_id", "rule", "start", "end")


_ISLANDS = """, o AS (SELECT doc_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM sp),
  m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o) GROUP BY doc_id, g)"""


@query(f"""WITH {_overlap_sql()}{_ISLANDS} SELECT doc_id, s::INT AS start, e::INT AS "end" FROM m""")
def merge_spans(t: Tables) -> DataFrame:
    return unnest(t.probed, ["doc_id"], S.merge_spans(_overlapping()), "start")


@query("""WITH sp AS (SELECT l_returnflag AS doc_id, l_orderkey * 3 AS s, l_orderkey * 3 + l_linenumber AS e FROM lineitem)""" + _ISLANDS + """
  SELECT doc_id AS l_returnflag, s::BIGINT AS start, e::BIGINT AS "end" FROM m""")
def merge_islands(t: Tables) -> DataFrame:
    # Three keys own all rows: the skewed case the bucketed form exists for.
    spans = t.lineitem.select("l_returnflag", (F.col("l_orderkey") * 3).alias("start"), (F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("end"))
    return intervals.merge_islands(spans, ["l_returnflag"])


@query(f"""WITH {I.FLAT}, {_hits_sql()} SELECT doc_id, s::INT AS start, (s + length(v))::INT AS "end", '[' || rule || ']' AS replacement FROM rule_hits""")
def build_replacements(t: Tables) -> DataFrame:
    return unnest(t.probed, ["doc_id"], S.build_replacements(R.rule_spans(_text(), RULES)), "start")


@query(f"""WITH {I.PROBED} SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '<n>', 'g')) AS digest FROM probed""")
def apply_replacements(t: Tables) -> DataFrame:
    numbers = S.find_spans(_text(), "[0-9]+", "n")
    tokens = F.transform(numbers, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("<n>").alias("replacement")))
    return t.probed.select("doc_id", F.md5(S.apply_replacements(_text(), tokens)).alias("digest"))


@query(f"""WITH {I.PROBED} SELECT doc_id, md5(regexp_replace(text, '[0-9a-f]+', '[MASKING]', 'g')) AS digest FROM probed""")
def mask_merged(t: Tables) -> DataFrame:
    # Runs of digits and runs of a-f touch inside one hexadecimal run and must merge into one token.
    spans = S.spans_of(_text(), [S.SpanRule("[0-9]+", "digits"), S.SpanRule("[a-f]+", "letters", ord=1)])
    return t.probed.select("doc_id", F.md5(S.mask_merged(_text(), spans)).alias("digest"))


_EMAIL_RE2 = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}($|\s|[<>,;:)\]]|[^\x00-\x7F])"
_LEFT = r"(^|[^\p{L}\p{N}_])"


def _redact_sql(c: str) -> str:
    steps = [(_EMAIL_RE2, "[이메일]\\1"), (_LEFT + r"(01[016789]-?\d{3,4}-?\d{4}\b)", "\\1[전화번호]"), (_LEFT + r"(0\d{1,2}-\d{3,4}-\d{4}\b)", "\\1[전화번호]"),
             (_LEFT + r"(\d{6}-?[1-4]\d{6}\b)", "\\1[주민등록번호]"), ("(?i)" + _LEFT + r"([MSR]\d{8}\b)", "\\1[여권번호]"),
             ("(?i)" + _LEFT + r"((?:\d{1,3}\.){3}\d{1,3}\b)", "\\1[IP주소]")]
    for p, token in steps:
        c = f"regexp_replace({c}, {I.lit(p)}, {I.lit(token)}, 'g')"
    return c


@query(f"""WITH {I.PROBED} SELECT doc_id, md5({_redact_sql('text')}) AS digest FROM probed""")
def redact_priority(t: Tables) -> DataFrame:
    redacted = P.redact_priority(_text(), ["email", "phone", "kr_rrn", "passport", "ip"])
    return t.probed.select("doc_id", F.md5(redacted).alias("digest"))


@query()
def redact_all_types(t: Tables) -> DataFrame:
    return t.probed.select("doc_id", F.md5(P.redact_priority(_text())).alias("digest"))


@query(f"WITH {I.PROBED} SELECT doc_id, 0 AS residue FROM probed")
def redact_residue(t: Tables) -> DataFrame:
    """What the redaction patterns still find behind redaction: nothing."""
    left = P.redaction_spans(F.col("clean"), P.C.PII_ENABLED)
    return t.probed.select("doc_id", P.redact_priority(_text()).alias("clean")).select("doc_id", F.size(left).alias("residue"))


_ENTITY = r"[a-z]+[0-9]{3}@[a-z.]+"


def _entities() -> Column:
    return F.transform(S.find_spans(_text(), _ENTITY, "MAIL"), lambda s: F.struct(
        s["value"].alias("word"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("entity_group")))


@query(f"""WITH {I.PROBED}, c AS (SELECT doc_id, text, string_split_regex(text, '{_ENTITY}') AS ps, {I.every('text', _ENTITY)} AS ms FROM probed)
  SELECT doc_id, md5(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(repeat('*', length(ms[i])), '')), '')) AS digest FROM c""")
def mask_entities(t: Tables) -> DataFrame:
    return t.probed.select("doc_id", F.md5(S.mask_entities(_text(), _entities())).alias("digest"))


@query(f"""WITH {I.PROBED} SELECT doc_id, v AS word, 'MAIL' AS type, CAST(s AS INT) || '-' || CAST(s + length(v) AS INT) AS position FROM {I.spans_sql('probed', 'text', _ENTITY)}""")
def list_entities(t: Tables) -> DataFrame:
    return unnest(t.probed, ["doc_id"], S.list_entities(_entities()), "word")


@query(f"""WITH {I.PROBED}, c AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM probed)
  SELECT doc_id, coalesce(array_to_string(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '[0-9]{{6}}')), ','), '') AS risky,
    md5(array_to_string(list_transform(ls, lambda l: CASE WHEN regexp_matches(l, '[0-9]{{6}}') THEN '[MASKED]' ELSE l END), chr(10))) AS digest FROM c""")
def mask_lines(t: Tables) -> DataFrame:
    # The verdicts on a text's lines are known in its row, so that's where it's masked.
    numbers = F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.when(line.rlike("[0-9]{6}"), i + 1)), lambda i: i.isNotNull())
    told = t.probed.select("doc_id", "text", numbers.alias("risky_lines"))
    out = told.withColumn("masked_text", L.mask_lines(_text(), F.col("risky_lines")))
    return out.select("doc_id", F.coalesce(F.array_join("risky_lines", ","), F.lit("")).alias("risky"), F.md5("masked_text").alias("digest"))
