"""Policy, account and sink queries. Policy tables are derived from the star schema, so they grow with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import accounts as A
from sieveline.operators import decisions as N
from sieveline.operators import policy as P
from sieveline.plans import inputs as I
from sieveline.plans.registry import Tables, query
from sieveline.sources import readers, sinks
from sieveline.sources.keyed_table import KeyedTable

# --- derived policy tables -------------------------------------------------------------------------------------------

_RULES = """SELECT 'r' || CAST(p_partkey AS STRING) AS id, p_name AS name, p_type AS targets, CAST(p_size AS INT) AS type_mask, 'AND' AS operator,
  'part' || CAST(p_partkey AS STRING) || '[0-9]+' AS rule, CASE WHEN p_partkey % 3 = 0 THEN CAST(2 AS INT) WHEN p_partkey % 3 = 1 THEN CAST(24 AS INT) END AS regex_flag,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(1 AS INT) END AS regex_group, CASE WHEN p_partkey % 4 = 0 THEN 'VAL' END AS regex_group_val,
  CASE p_partkey % 3 WHEN 0 THEN 'masking' WHEN 1 THEN 'block' ELSE 'accept' END AS action,
  CASE WHEN p_partkey % 5 = 0 THEN 'draft' ELSE 'deployed' END AS status FROM part"""
_BINDINGS = """SELECT 'b' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, 'f' || CAST(l_suppkey % 30 AS STRING) AS filter_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'service' WHEN 2 THEN 'group' ELSE 'default' END AS scope,
  'r' || CAST(l_partkey AS STRING) AS policy_rule_id, 'u' || CAST(l_orderkey % 2000 AS STRING) AS subject_id FROM lineitem"""
_FILTERS = """SELECT 'f' || CAST(n_nationkey AS STRING) AS id, CAST(n_regionkey AS INT) AS priority FROM nation"""
_USERS = """SELECT 'u' || CAST(c_custkey AS STRING) AS id, 'user' || CAST(c_custkey AS STRING) || '@example.com' AS email, c_mktsegment AS user_group_id,
  CAST(c_nationkey % 5 AS INT) AS ai_service_id FROM customer"""


def _over(t: Tables, text: str, table: str) -> DataFrame:
    """Evaluate ``SELECT … FROM table`` on a table of the given folder."""
    head, _, _ = text.rpartition(f" FROM {table}")
    return t.read(table).selectExpr(*_items(head.removeprefix("SELECT ")))


def _items(select: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(select):
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and depth == 0 and not quoted:
            out.append(select[start:i].strip())
            start = i + 1
    return [*out, select[start:].strip()]


def _rules(t: Tables) -> DataFrame:
    return _over(t, _RULES, "part")


def _bindings(t: Tables) -> DataFrame:
    return _over(t, _BINDINGS, "lineitem")


def _filters(t: Tables) -> DataFrame:
    return _over(t, _FILTERS, "nation")


def _users(t: Tables) -> DataFrame:
    return _over(t, _USERS, "customer")


_CTES = f"""rules AS ({_RULES}), deployed AS (SELECT * FROM rules WHERE status = 'deployed'), bindings AS ({_BINDINGS}), filters AS ({_FILTERS}), users AS ({_USERS})"""


@query(f"WITH {_CTES} SELECT id, name, action, rule, regex_flag FROM deployed")
def scan_rules_db(t: Tables) -> DataFrame:
    return readers.deployed_rules(_rules(t)).select("id", "name", "action", "rule", "regex_flag")


@query(f"WITH {_CTES} SELECT id, action, (CASE action WHEN 'masking' THEN 0 WHEN 'block' THEN 1 ELSE 2 END)::INT AS ord FROM deployed")
def order_rules(t: Tables) -> DataFrame:
    return P.order_rules(readers.deployed_rules(_rules(t))).select("id", "action", "ord")


@query(f"WITH {_CTES} SELECT id, filter_id, scope, policy_rule_id, subject_id FROM bindings WHERE filter_id = 'f7'")
def scan_rule_bindings(t: Tables) -> DataFrame:
    return readers.scan_rule_bindings(_bindings(t), "f7")


@query(f"WITH {_CTES} SELECT id, email, user_group_id, ai_service_id, email || '_' || ai_service_id AS user_key FROM users")
def scan_users(t: Tables) -> DataFrame:
    return readers.scan_users(_users(t))


_SETTINGS = """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'file-control' ELSE 'other' END AS category,
  CASE o_orderstatus WHEN 'O' THEN 'fileControlAllowedExtensions' WHEN 'F' THEN 'fileControlMaxSize' ELSE 'x' END AS skey,
  CASE o_orderstatus WHEN 'O' THEN 'doc,docx,' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END AS svalue FROM orders"""


@query(f"""WITH s AS ({_SETTINGS}) SELECT replace(max(svalue) FILTER (skey = 'fileControlAllowedExtensions'), ',', '|') AS allow_ext,
  (max(svalue) FILTER (skey = 'fileControlMaxSize'))::INT AS max_size FROM s WHERE category = 'file-control'""")
def scan_settings_pivot(t: Tables) -> DataFrame:
    return readers.scan_settings_pivot(_over(t, _SETTINGS, "orders")).select(F.array_join("allow_ext", "|").alias("allow_ext"), "max_size")


@query(f"""WITH {_CTES}, b AS (SELECT b.filter_id, b.scope, r.action, r.id FROM bindings b LEFT JOIN deployed r ON b.policy_rule_id = r.id)
  SELECT filter_id, scope, coalesce(action, 'rejected') AS action, count(*) AS n FROM b GROUP BY ALL""")
def join_bindings_rules(t: Tables) -> DataFrame:
    joined, rejects = P.join_bindings_rules(_bindings(t), readers.deployed_rules(_rules(t)))
    both = joined.select("filter_id", "scope", "action").unionByName(rejects.select("filter_id", "scope", F.lit("rejected").alias("action")))
    return both.groupBy("filter_id", "scope", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CTES} SELECT filter_id, count(*) AS n FROM bindings WHERE filter_id IN (SELECT id FROM filters) GROUP BY filter_id")
def join_filters_bindings(t: Tables) -> DataFrame:
    return P.join_filters_bindings(_filters(t), _bindings(t)).groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CTES} SELECT scope, u.user_group_id AS grp, count(*) AS n FROM bindings b LEFT JOIN users u ON b.subject_id = u.id AND b.scope = 'user' GROUP BY ALL""")
def join_user_scope(t: Tables) -> DataFrame:
    out = P.join_user_scope(_bindings(t), _users(t))
    return out.groupBy("scope", F.col("subject_val.user_group_id").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def _bound(t: Tables) -> DataFrame:
    joined, _ = P.join_bindings_rules(_bindings(t), P.order_rules(readers.deployed_rules(_rules(t))))
    return joined


_SCOPE_SQL = """scope_map AS (SELECT b.filter_id, b.scope, r.id, r.action, r.rule, coalesce(r.regex_flag, 16) AS regex_flag, coalesce(r.regex_group, 0) AS regex_group,
  CASE WHEN b.scope <> 'default' THEN b.subject_id END AS subject_id FROM bindings b JOIN deployed r ON b.policy_rule_id = r.id)"""


@query(f"""WITH {_CTES}, {_SCOPE_SQL} SELECT filter_id, scope, id, regex_flag::INT AS regex_flag, regex_group::INT AS regex_group, subject_id,
  CASE regex_flag WHEN 2 THEN '(?i)' WHEN 24 THEN '(?ms)' ELSE '(?s)' END AS inline_flags FROM scope_map""")
def compile_scope_map(t: Tables) -> DataFrame:
    return P.compile_scope_map(_bound(t)).select("filter_id", "scope", "id", "regex_flag", "regex_group", "subject_id", "inline_flags")


@query(f"WITH {_CTES}, {_SCOPE_SQL} SELECT filter_id, count(*) AS n FROM scope_map GROUP BY filter_id")
def rule_count(t: Tables) -> DataFrame:
    return P.rule_count(P.compile_scope_map(_bound(t)))


# The new policy lacks some rules, changes some actions, adds some rules, and has nothing at all for the groups of one filter.
@query(f"""WITH {_CTES}, {_SCOPE_SQL}, all_new AS (SELECT filter_id, scope, id, CASE WHEN id LIKE '%7' THEN 'allow' ELSE action END AS action, rule FROM scope_map WHERE id NOT LIKE '%3'
    UNION ALL SELECT filter_id, scope, 'new-' || filter_id, 'block', 'x' FROM scope_map WHERE id LIKE '%11'),
  new_map AS (SELECT * FROM all_new WHERE NOT (filter_id = 'f3' AND scope = 'group')),
  o AS (SELECT filter_id, scope, id, count(*) AS n, max(action) AS action, max(rule) AS rule FROM scope_map GROUP BY ALL),
  w AS (SELECT filter_id, scope, id, count(*) AS n, max(action) AS action, max(rule) AS rule FROM new_map GROUP BY ALL)
  SELECT filter_id, scope, id, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM o FULL JOIN w USING (filter_id, scope, id) WHERE (o.n IS NULL OR w.n IS NULL OR o.n <> w.n OR o.action <> w.action OR o.rule <> w.rule)
    AND (filter_id, scope) IN (SELECT (filter_id, scope) FROM new_map)""")
def policy_diff(t: Tables) -> DataFrame:
    # Both policies come from one join of bindings and rules.
    one, none = F.lit(1), F.lit(0)
    side = lambda id_, action, rule, old, new: F.struct(id_.alias("id"), action.alias("action"), rule.alias("rule"), old.alias("old"), new.alias("new"))
    id_, action, rule = F.col("id"), F.col("action"), F.col("rule")
    listed = ~((F.col("filter_id") == "f3") & (F.col("scope") == "group"))
    sides = F.array(
        side(id_, action, rule, one, none),
        F.when(listed & ~id_.like("%3"), side(id_, F.when(id_.like("%7"), "allow").otherwise(action), rule, none, one)),
        F.when(listed & id_.like("%11"), side(F.concat(F.lit("new-"), "filter_id"), F.lit("block"), F.lit("x"), none, one)))
    return P.diff_of_sides(P.compile_scope_map(_bound(t)).select("filter_id", "scope", F.inline(F.array_compact(sides))))


@query(f"""WITH {_CTES} SELECT f.id, f.priority FROM filters f""")
def order_filters(t: Tables) -> DataFrame:
    return N.order_filters(_filters(t)).select("id", "priority")


# User rules from customers, service rules from regions, default rules from parts, each bound by two filters; requests are the events.
def _scopes(t: Tables) -> DataFrame:
    user = t.customer.select(F.lit("f-user").alias("filter_id"), F.lit("user").alias("scope"), F.lit(0).alias("ord"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
                             F.lit("x").alias("rule"), F.col("c_mktsegment").alias("action"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("subject_id"))
    service = t.region.select(F.lit("f-service").alias("filter_id"), F.lit("service").alias("scope"), F.lit(1).alias("ord"), F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("id"),
                              F.lit("x").alias("rule"), F.lit("masking").alias("action"), F.col("r_regionkey").cast("string").alias("subject_id"))
    default = t.part.select(F.explode(F.array(F.lit("f-default"), F.lit("f-other"))).alias("filter_id"), F.lit("default").alias("scope"), (F.col("p_size") % 3).cast("int").alias("ord"),
                            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("x").alias("rule"), F.lit("block").alias("action"), F.lit(None).cast("string").alias("subject_id"))
    return user.unionByName(service).unionByName(default)


@query("""WITH q AS (SELECT event_id, 'u' || user_id AS user_uuid, (user_id % 8)::VARCHAR AS svc FROM events)
  SELECT event_id, 0 AS scope_rank, 'user' AS scope, 'f-user' AS filter_id, 'c' || c_custkey AS rule_id, c_mktsegment AS action FROM q JOIN customer ON user_uuid = 'u' || c_custkey
  UNION ALL SELECT event_id, 1, 'service', 'f-service', 's' || r_regionkey, 'masking' FROM q JOIN region ON svc = r_regionkey::VARCHAR
  UNION ALL SELECT NULL, 3, 'default', unnest(['f-default', 'f-other']), 'p' || p_partkey, 'block' FROM part""")
def effective_rules(t: Tables) -> DataFrame:
    requests = t.events.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_uuid"), (F.col("user_id") % 8).alias("ai_service"), F.lit(None).cast("string").alias("user_group_id"))
    scopes = _scopes(t)
    own = P.effective_rules(requests, scopes, message_id="event_id")
    everyone = P.default_rules(scopes).withColumn("event_id", F.lit(None).cast("bigint"))
    return own.unionByName(everyone).select("event_id", "scope_rank", "scope", "filter_id", "rule_id", "action")


# --- accounts --------------------------------------------------------------------------------------------------------

_SEEN = """(SELECT 'user' || (user_id * 7) || '@example.com' AS email, (user_id % 5)::INT AS ai_service, event_id, ts FROM events)"""


def _seen(t: Tables) -> DataFrame:
    return t.events.select(F.concat(F.lit("user"), (F.col("user_id") * 7).cast("string"), F.lit("@example.com")).alias("email"), (F.col("user_id") % 5).cast("int").alias("ai_service"), "event_id", "ts")


def _stored(t: Tables) -> DataFrame:
    return readers.scan_users(_users(t))


_KEYS = f"k AS (SELECT DISTINCT email || '_' || ai_service AS user_key FROM {_SEEN}), st AS (SELECT email || '_' || ai_service_id AS user_key, id FROM ({_USERS}))"
_UUID = ("left(h, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12)")


@query(f"WITH {_KEYS} SELECT user_key FROM k WHERE user_key NOT IN (SELECT user_key FROM st)")
def new_accounts(t: Tables) -> DataFrame:
    return A.new_accounts(A.seen_accounts(_seen(t)), _stored(t)).select("user_key")


@query(f"WITH {_KEYS} SELECT user_key FROM k EXCEPT SELECT user_key FROM st")
def except_known_accounts(t: Tables) -> DataFrame:
    return A.seen_accounts(_seen(t)).select("user_key").subtract(_stored(t).select("user_key"))


@query(f"WITH {_KEYS}, u AS (SELECT k.user_key, st.id, sha256(k.user_key) AS h FROM k LEFT JOIN st USING (user_key)) SELECT user_key, coalesce(id, {_UUID}) AS uuid FROM u")
def assign_uuid(t: Tables) -> DataFrame:
    return A.assign_uuid(A.seen_accounts(_seen(t)), _stored(t)).select("user_key", "uuid")


@query(f"""WITH u AS ({_USERS}), n AS (SELECT 'u' || (user_id * 11) AS id, 'seen@' || max_by(event_type, event_id) AS email, 'g' || max_by(CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR ELSE '-' END, event_id) AS grp FROM events GROUP BY user_id)
  SELECT coalesce(n.id, u.id) AS id, coalesce(n.email, u.email) AS email, coalesce(nullif(grp, 'g-'), u.user_group_id) AS user_group_id FROM u FULL JOIN n ON u.id = n.id""")
def sink_account_upsert(t: Tables) -> DataFrame:
    target = _users(t).select("id", "email", "user_group_id")
    new = t.events.select(F.concat(F.lit("u"), (F.col("user_id") * 11).cast("string")).alias("id"), F.concat(F.lit("seen@"), "event_type").alias("email"),
                          F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("g"), F.col("event_id").cast("string"))).alias("user_group_id"), "event_id")
    table = KeyedTable(t.spark, t.work("account-upsert"), "id", target.schema, 16)
    table.rewrite(target, lambda _, rows: rows)
    sinks.sink_account_upsert(table, new, table.path, "id", order="event_id")
    return table.rows()


@query(f"""WITH {_KEYS}, u AS (SELECT user_key, sha256(user_key) AS h FROM k WHERE user_key NOT IN (SELECT user_key FROM st)) SELECT {_UUID} AS id, user_key FROM u""")
def sink_account_insert(t: Tables) -> DataFrame:
    fresh = A.new_accounts(A.seen_accounts(_seen(t)), _stored(t))
    path = t.work("account-insert")
    sinks.sink_account_insert(fresh.withColumn("uuid", A.account_uuid(F.col("user_key"))), path)
    return t.spark.read.parquet(path).select("id", "user_key")


# --- sinks, as the rows they would write -----------------------------------------------------------------------------


@query("""WITH e AS (SELECT 'm-' || (event_id % 7000) || ':query' AS doc_key, event_id FROM events), s AS (SELECT 'm-' || (user_id * 13) || ':query' AS doc_key, min(-event_id) AS event_id FROM events GROUP BY user_id)
  SELECT * FROM s UNION ALL SELECT doc_key, min(event_id) AS event_id FROM e WHERE doc_key NOT IN (SELECT doc_key FROM s) GROUP BY doc_key""")
def sink_idempotent_create(t: Tables) -> DataFrame:
    path = t.work("create")
    key = lambda c: sinks.document_id(F.concat(F.lit("m-"), c.cast("string"))).alias("doc_key")
    sinks.sink_idempotent_create(t.events.select(key(F.col("user_id") * 13), (-F.col("event_id")).alias("event_id")), path, "doc_key", "event_id")
    new = t.events.select(key(F.col("event_id") % 7000), "event_id")
    for _ in range(2):  # the second time changes nothing
        table = sinks.sink_idempotent_create(new, path, "doc_key", "event_id")
    return table.rows()


@query("""SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id""")
def sink_upsert_latest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    old, new = rows.where(F.col("event_type") == "click"), rows.where(F.col("event_type") != "click")
    path = t.work("latest")
    sinks.sink_upsert_latest(old, path, path, "user_id", "event_id")
    return sinks.sink_upsert_latest(new, path, path, "user_id", "event_id").rows()


@query(f"""WITH {I.PROBED}, d AS (SELECT doc_id, text, regexp_matches(text, 'AKIA[0-9]{{16}}') AS hit FROM probed)
  SELECT 0::SMALLINT AS agent_id, md5(text) AS digest, 's-' || (doc_id % 97) AS session_id, (CASE WHEN hit THEN 0 ELSE 1 END)::SMALLINT AS allowed, '' AS modified_prompt, CASE WHEN hit THEN 'aws key' ELSE '' END AS reason FROM d""")
def sink_prompt_log(t: Tables) -> DataFrame:
    hit = F.col("text").rlike("AKIA[0-9]{16}")
    decided = t.probed.select(F.col("text").alias("prompt"), F.lit(None).cast("timestamp").alias("at"), F.concat(F.lit("s-"), (F.col("doc_id") % 97).cast("string")).alias("session_id"),
                              F.when(hit, "block").otherwise("allow").alias("action"), F.lit(None).cast("string").alias("masked_contents"), F.when(hit, "aws key").alias("reason"))
    path = t.work("prompt-log")
    sinks.sink_prompt_log(decided, path)
    return t.spark.read.parquet(path).select("agent_id", F.md5("prompt").alias("digest"), "session_id", "allowed", "modified_prompt", "reason")


@query("""SELECT CASE conv_id % 5 WHEN 0 THEN 'input_filter' WHEN 1 THEN 'regex_filter' WHEN 2 THEN 'output_filter' WHEN 3 THEN 'llm_filter' ELSE 'other' END AS index, conv_id % 5 < 4 AS known,
  sum(len(string_split(text, chr(10))))::BIGINT AS n FROM conversations GROUP BY ALL""")
def ingest_log_batch(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("input_filter", "regex_filter", "output_filter", "llm_filter", "other")])
    batches = t.conversations.select(F.element_at(names, (F.col("conv_id") % 5 + 1).cast("int")).alias("index"), F.transform(
        F.split("text", "\n", -1), lambda line: F.to_variant_object(F.struct(line.alias("line")))).alias("log_list"))
    return readers.ingest_log_batch(batches).groupBy("index", "known").agg(F.count("log").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' AND value > 5")
def scan_prompt_log(t: Tables) -> DataFrame:
    return readers.scan_prompt_log(t.events.select("event_id", "event_type", "value"), (F.col("event_type") == "error") & (F.col("value") > 5)).drop("value")


@query("SELECT count(*) AS n FROM (SELECT event_id FROM events LIMIT 50)")
def limit_log(t: Tables) -> DataFrame:
    return readers.limit_log(t.events.select("event_id"), 50).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def latency_stats(t: Tables) -> DataFrame:
    return N.latency_stats(t.events, "value", "event_type").withColumn("avg", F.round("avg", 6))

