import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import accounts as A
from sieveline.operators import decisions as N
from sieveline.operators import policy as P
from sieveline.operators import rules as R
from sieveline.operators.intervals import merge_islands
from sieveline.sources import readers

RULE_DDL = "ord int, id string, name string, rule string, action string, regex_flag int, regex_group_val string"


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "ab12 AB"), (2, "zz"), (3, "12 ab 34\nab"), (4, None)], "id int, text string")


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rule_matching_forms_agree(spark, texts):
    table = spark.createDataFrame([(i, f"r{i:03d}", f"n{i}", p, "block", f, None) for i, (p, f) in enumerate([("ab", 0), (r"\d+", 0), ("AB", 2), ("4.a", 16), ("4.a", 0)])], RULE_DDL)
    joined = _rows(R.join_text_rules(texts, ["id"], "text", table), "id", "ord")
    assert joined == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1), (3, 2), (3, 3)]
    hits = R.detect_rules(texts, ["id"], "text", table)
    assert sorted({(r.id, r.ord) for r in hits.collect()}) == joined
    assert _rows(hits.where("ord = 1"), "id", "ordinal", "start", "end", "value") == [(1, 0, 2, 4, "12"), (3, 0, 0, 2, "12"), (3, 1, 6, 8, "34")]
    first = R.first_hit_per_text(hits.withColumn("k", F.struct("ord", "start")), "id", "k", "ord", "value")
    assert _rows(first, "id", "ord", "value") == [(1, 0, "ab"), (3, 0, "ab")]


def test_large_rule_tables_are_one_scan(spark, texts):
    same = [(0, "same", f"n{i}", "ab" if i % 2 else "zz", "block", 0, None) for i in range(300)]
    table = spark.createDataFrame([*same, (0, None, "a", "ab", "block", 0, None), (0, None, "b", "ab", "block", 0, None), (None, "x", "c", "zz", None, None, None)], RULE_DDL)
    assert len(R.load_rules(table)) == 303
    got = R.join_text_rules(texts, ["id"], "text", table)
    assert got.count() == 2 * 152 + 151
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
    assert R.detect_rules(texts, ["id"], "text", table).select("id", "rule").distinct().count() == 2 * 152 + 151
    with pytest.raises(ValueError, match="more than 302 rules"):
        R.load_rules(table, 302)


def test_default_rules_bound_by_many_filters(spark):
    scopes = spark.createDataFrame([(f"f{i}", "default", 0, "r", "block", None) for i in range(300)] + [(f"f{i}", "service", 1, "s", "block", "4") for i in range(250)],
                                   "filter_id string, scope string, ord int, id string, action string, subject_id string")
    asked = spark.createDataFrame([(f"m{i}", "u", 4, None) for i in range(50)], "message_id string, user_uuid string, ai_service int, user_group_id string")
    assert P.default_rules(scopes).select("filter_id").distinct().count() == 300
    assert P.effective_rules(asked, scopes).groupBy("message_id").count().where("count = 250").count() == 50


def test_quarantine_and_decode(spark):
    bad = [("ok", "a+b"), ("open", "(a"), ("empty", ""), ("blank", "a*"), ("null", None)]
    good, rejected = R.quarantine_rules(spark.createDataFrame(bad, "id string, rule string"))
    assert [r.id for r in good.collect()] == ["ok"]
    assert {r.id for r in rejected.collect()} == {"open", "empty", "blank", "null"}
    coded = spark.createDataFrame([("a", "YWI="), ("b", "***"), ("c", "/w=="), ("d", None)], "id string, rule string")
    ok, failed = R.decode_rules(coded)
    assert [tuple(r) for r in ok.select("id", "rule").collect()] == [("a", "ab")]
    assert {r.id for r in failed.collect()} == {"b", "c", "d"}
    usable, broken = R.engine_checked(spark, [R.Rule(0, "0", "x", "a"), R.Rule(1, "1", "y", r"(?<=a+)b"), R.Rule(2, "2", "z", "c")])
    assert [r.id for r in usable] == ["0", "2"] or not broken
    assert len(usable) + len(broken) == 3


def test_nested_groups_and_empty_matches_go_through_python(spark, texts):
    rule = R.Rule(0, "0", "opt", r"(?:(?P<V>a)b|\d(?P<W>\d))", group="V")
    want = [(1, 0, 1, "a"), (3, 3, 4, "a"), (3, 9, 10, "a")]
    assert _rows(R.spans_in_python(texts, ["id"], "text", [rule]), "id", "start", "end", "value") == want
    mixed = [rule, R.Rule(1, "1", "foo", "(?=z)|foo"), R.Rule(2, "2", "ab", "ab")]
    df = texts.union(spark.createDataFrame([(5, "zz foo z foo")], "id int, text string"))
    got = _rows(R.detect_rules(df, ["id"], "text", mixed), "id", "ord", "ordinal", "start", "end", "value")
    assert [r for r in got if r[1] == 1] == [(5, 1, 0, 3, 6, "foo"), (5, 1, 1, 9, 12, "foo")]
    assert len([r for r in got if r[1] == 0]) == 3 and len([r for r in got if r[1] == 2]) == 3
    with pytest.raises(ValueError, match="can match empty text"):
        R.rule_spans(F.col("text"), mixed[1:])


def test_rule_export(spark, tmp_path):
    rules = [{"id": "1", "name": " PHONE ", "rule": r"\d{3}", "action": "block", "status": "Deployed"}, {"id": "2", "name": "", "rule": "x", "status": "deployed"},
             {"id": "3", "name": "bad", "rule": "(", "status": "deployed"}, {"id": "4", "name": "draft", "rule": "x", "status": "draft"}, {"id": "5", "name": "none", "rule": "", "status": "deployed"}]
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"statusCode": 200, "data": rules}, indent=1))
    got = readers.scan_rules_json(spark, str(path)).orderBy("ord").collect()
    assert [(r.id, r.name, r.type, r.token) for r in got] == [("1", "PHONE", "phone", "[PHONE]"), ("2", "UNNAMED", "unnamed", "[UNNAMED]")]


def test_scope_map_and_effective_rules(spark):
    rules = P.order_rules(spark.createDataFrame([("r1", "n1", "x", "block", None, None, None), ("r2", "n2", "y", "masking", 2, 1, "V"), ("r3", "n3", "z", "accept", 24, 0, None)],
                                                "id string, name string, rule string, action string, regex_flag int, regex_group int, regex_group_val string"))
    assert _rows(rules, "id", "ord") == [("r1", 1), ("r2", 0), ("r3", 2)]
    bindings = spark.createDataFrame([("b1", "f1", "user", "r1", "u1"), ("b2", "f1", "default", "r2", None), ("b3", "f2", "service", "r3", "4"), ("b4", "f1", "group", "gone", "g1"), ("b5", "f1", "group", "r3", "g1")],
                                     "id string, filter_id string, scope string, policy_rule_id string, subject_id string")
    bound, rejects = P.join_bindings_rules(bindings, rules)
    assert [r.binding_id for r in rejects.collect()] == ["b4"]
    users = spark.createDataFrame([("u1", "a@x.com"), ("u2", "b@x.com")], "id string, email string")
    assert _rows(P.join_user_scope(bound, users), "binding_id", F.col("subject_val.email")) == [("b1", "a@x.com"), ("b2", None), ("b3", None), ("b5", None)]
    scopes = P.compile_scope_map(bound)
    assert _rows(scopes, "id", "regex_flag", "regex_group", "inline_flags") == [("r1", 16, 0, "(?s)"), ("r2", 2, 1, "(?i)"), ("r3", 24, 0, "(?ms)"), ("r3", 24, 0, "(?ms)")]
    assert _rows(P.rule_count(scopes), "filter_id", "n") == [("f1", 3), ("f2", 1)]
    assert P.in_scopes(scopes).count() == 1
    asked = spark.createDataFrame([("m1", "u1", 4, "g1"), ("m2", "u9", 0, None)], "message_id string, user_uuid string, ai_service int, user_group_id string")
    got = _rows(P.effective_rules(asked, scopes), "message_id", "scope_rank", "rule_id")
    assert got == [("m1", 0, "r1"), ("m1", 1, "r3"), ("m1", 2, "r3")]
    assert _rows(P.default_rules(scopes), "scope_rank", "filter_id", "rule_id") == [(3, "f1", "r2")]
    filters = spark.createDataFrame([("f1",), ("f3",)], "id string")
    assert [r.id for r in P.filters_in_use(filters, bindings).collect()] == ["f1"]
    assert P.join_filters_bindings(filters, bindings).count() == 4


def test_policy_diff(spark):
    ddl = "filter_id string, scope string, id string, action string, rule string, name string"
    old = spark.createDataFrame([("f", "user", "1", "block", "a", "x"), ("f", "user", "2", "block", "b", "x"), ("f", "user", "3", None, "c", "x"), ("f", "user", "4", "block", "d", "x"), ("f", "user", "4", "block", "d", "x")], ddl)
    new = spark.createDataFrame([("f", "user", "1", "block", "a", "renamed"), ("f", "user", "2", "allow", "b", "x"), ("f", "user", "3", None, "c", "x"), ("f", "user", "4", "block", "d", "x"), ("f", "user", "5", "block", "e", "x")], ddl)
    assert _rows(P.policy_diff(old, new), "id", "change") == [("2", "modified"), ("4", "modified"), ("5", "added")]
    assert not P.policy_changed(old, old) and P.policy_changed(old, new)
    # Nothing listed for a scope leaves it as it is; a scope that is listed loses what is missing.
    other = spark.createDataFrame([("f", "group", "9", "block", "a", "x"), ("g", None, "1", "block", "a", "x")], ddl)
    assert _rows(P.policy_diff(old, other), "id", "change") == [("1", "added"), ("9", "added")]
    assert P.policy_changed(old, old.where("id = '1'")) and not P.policy_changed(old, old.limit(0))


# --- decisions -------------------------------------------------------------------------------------------------------

CHAINS = {"allow": ["allow", "allow"], "mask": ["masking", "allow"], "mask_block": ["masking", "block", "allow"], "block_first": ["block", "masking"], "two_blocks": ["block", "block"], "two_masks": ["masking", "masking"]}


def _long(spark):
    code = {"allow": 0, "block": 1, "masking": 2}
    rows = [(k, i, f"f{i}", a, code[a], f"m{i}", f"b{i}") for k, chain in CHAINS.items() for i, a in enumerate(chain)]
    rows += [("no_code", 0, "f0", "block", None, "m0", "b0"), ("no_code", 1, "f1", "masking", 2, "m1", "b1")]
    return spark.createDataFrame(rows, "message_id string, ord int, filter_id string, action string, action_code int, masked_contents string, block_message string")


def test_chain_and_decision(spark):
    long = _long(spark)
    packed = long.groupBy("message_id").agg(F.collect_list(F.struct("ord", "filter_id", "action", "action_code", "masked_contents", "block_message")).alias("v"))
    reached = packed.select("message_id", F.inline(N.run_filter_chain(F.col("v"))))
    want = {"allow": 2, "mask": 2, "mask_block": 2, "block_first": 1, "two_blocks": 1, "two_masks": 2, "no_code": 1}
    assert {r.message_id: r["count"] for r in reached.groupBy("message_id").count().collect()} == want
    assert _rows(reached, "message_id", "ord") == _rows(N.run_filter_chain_table(long), "message_id", "ord")
    final = packed.select("message_id", N.final_decision(N.run_filter_chain(F.col("v"))).alias("d")).select("message_id", "d.*")
    by_table = N.final_decision_table(long, stop_at_block=True)
    assert sorted(by_table.collect()) == sorted(N.final_decision_table(N.run_filter_chain_table(long)).select(by_table.columns).collect())
    cols = ("message_id", "action", "action_code", "masked_contents", "block_message")
    assert _rows(final, *cols) == _rows(by_table, *cols)
    got = {r.message_id: (r.action, r.block_message) for r in final.collect()}
    assert got == {"allow": ("allow", ""), "mask": ("masking", "b0"), "mask_block": ("block", "b1"), "block_first": ("block", "b0"), "two_blocks": ("block", "b0"), "two_masks": ("masking", "b0"), "no_code": ("allow", "")}


def test_empty_chain(spark):
    row = spark.range(1).select(N.final_decision(F.array().cast("array<struct<ord:int,filter_id:string,action:string,action_code:int,masked_contents:string,block_message:string>>")).alias("d")).first()
    assert row.d.action == "allow" and row.d.action_code == 0


def test_regex_filter_policies(spark):
    df = spark.createDataFrame([("mail a@b.com now",), ("flag me",), ("plain",)], "text string")

    def run(**k):
        return [tuple(r) for r in N.regex_filter(df, "text", patterns=["flag"], **k).select("final_action", "action", "should_block", "content").collect()]

    assert run() == [("MASKING_REDACT", "masking", True, "mail [이메일] now"), ("ALLOW", "allow", True, "flag me"), ("ALLOW", "allow", False, "plain")]
    assert run(policy="block")[0] == ("BLOCK_MSG", "block", True, "mail a@b.com now")
    assert run(policy="block", block_on_match=False)[0] == ("MASKING_REDACT", "masking", False, "mail [이메일] now")
    assert run(policy="allow")[0][:2] == ("ALLOW", "allow")
    assert run(redact=False)[0][:2] == ("ALLOW", "allow")


def test_rule_filter_policies(spark):
    df = spark.createDataFrame([("id 12 ab",), ("-",)], "text string")
    rules = R.as_rules([("NUM", r"\d+", "block", 0, None), ("WORD", "ab", "masking", 0, None)])
    masked = N.rule_filter(df, "text", rules).collect()
    assert (masked[0].action, masked[0].content, masked[0].match_counts) == ("masking", "id [NUM] [WORD]", {"num": 1, "word": 1})
    assert (masked[1].action, masked[1].content) == ("allow", "-")
    assert N.rule_filter(df, "text", rules, policy="block").first().action == "block"


# --- intervals -------------------------------------------------------------------------------------------------------


def test_merge_islands_against_running_scan(spark):
    import random

    rng = random.Random(4)
    rows = [(k, s, s + rng.randint(1, 400)) for k in "ab" for s in (rng.randrange(0, 9000) for _ in range(300))] + [("c", 0, 100_000), ("c", 99_999, 100_005), ("c", 100_005, 100_006), ("c", 100_008, 100_009)]
    want = []
    for k in "abc":
        out = []
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if out and s <= out[-1][2]:
                out[-1][2] = max(out[-1][2], e)
            else:
                out.append([k, s, e])
        want += [tuple(x) for x in out]
    df = spark.createDataFrame(rows, "k string, start int, end int")
    for bucket in (16, 1000, 65_536):
        assert _rows(merge_islands(df, ["k"], bucket=bucket), "k", "start", "end") == sorted(want)


# --- accounts --------------------------------------------------------------------------------------------------------


def test_accounts(spark):
    seen = A.seen_accounts(spark.createDataFrame([("a@x", 1), ("a@x", 1), ("b@x", 2)], "email string, ai_service int"))
    stored = spark.createDataFrame([("id-a", "a@x_1")], "id string, user_key string")
    assert [r.user_key for r in A.new_accounts(seen, stored).collect()] == ["b@x_2"]
    ids = {r.user_key: r.uuid for r in A.assign_uuid(seen, stored).collect()}
    assert ids["a@x_1"] == "id-a" and len(ids["b@x_2"]) == 36 and ids["b@x_2"][14] == "4"
    assert ids == {r.user_key: r.uuid for r in A.assign_uuid(seen, stored).collect()}
    target = spark.createDataFrame([("1", "old", 5), ("2", "keep", 6)], "user_id string, email string, n int")
    new = spark.createDataFrame([("1", "new"), ("3", "add")], "user_id string, email string")
    assert _rows(A.upsert(target, new, "user_id", "email").na.fill(0), "user_id", "email", "n") == [("1", "new", 5), ("2", "keep", 6), ("3", "add", 0)]
