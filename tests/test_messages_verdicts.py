import pytest
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import messages as M
from sieveline.functions import verdicts as V
from sieveline.functions.verdicts import salvage_object
from sieveline.operators import turns
from sieveline.schemas import MESSAGES
from sieveline.sources import readers


@pytest.fixture
def chats(spark):
    chat = [[("system", "be nice", None), ("user", "q1", None), ("assistant", "a1", None), ("user", None, [("image", None), ("text", "part")])], [("assistant", "only", None)], [], None]
    return spark.createDataFrame([(i, c) for i, c in enumerate(chat)], f"id int, m {MESSAGES}").orderBy("id")


def _eval(df, col):
    return [r[0] for r in df.select(col.alias("v"), "id").orderBy("id").collect()]


def test_message_lookups(chats):
    m = F.col("m")
    assert _eval(chats, M.last_user_message(m)) == ["part", None, None, None]
    assert _eval(chats, M.last_assistant_message(m)) == ["a1", "only", None, None]
    assert _eval(chats, M.last_message(m)) == ["part", "only", "", ""]
    assert _eval(chats, M.get_system_message(m)["content"]) == ["be nice", None, None, None]
    assert _eval(chats, F.size(M.remove_system_messages(m)))[:3] == [3, 1, 0]
    assert _eval(chats, M.upsert_system_message(m, F.lit("new"))[0]["content"])[:3] == ["new\nbe nice", "new", "new"]
    assert _eval(chats, F.size(M.ensure_language_prompt(m, F.lit(True))))[:3] == [5, 2, 1]
    assert _eval(chats, F.size(M.ensure_language_prompt(m, F.lit(False))))[:3] == [4, 1, 0]
    assert _eval(chats, M.last_message(M.replace_last_content(m, F.lit("X"))))[:3] == ["X", "X", ""]


def test_long_conversations_stay_whole(spark):
    role = F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    long = spark.range(2500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("t"), "id").alias("text")).repartition(5)
    (row,) = readers.scan_conversations(long).collect()
    assert [m.content for m in row.messages] == [f"t{i}" for i in range(2500)]
    (found,) = long.groupBy("conv_id").agg(turns.last_text("user").alias("u"), turns.last_text("assistant").alias("a"), turns.last_text().alias("l"), turns.system_text().alias("s")).collect()
    assert (found.u, found.a, found.l, found.s) == ("t2498", "t2499", "t2499", "t0")
    assert readers.latest_turn(long, "user").first().text == "t2498"
    assert [r.text for r in readers.recent_history(long, 3).orderBy("age").collect()] == ["t2499", "t2498", "t2497"]
    told = turns.upsert_system(long, F.lit("new"))
    assert told.count() == 2500 and [r.text for r in told.where("role = 'system'").collect()] == ["new\nt0"]
    ok, bad = readers.reject_invalid_prompt(long.groupBy("conv_id").agg(turns.last_text("user").alias("u")), "u")
    assert (ok.count(), bad.count()) == (1, 0)


def test_edits_of_stored_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "system", "s"), (2, 5, "system", f"x {C.LANGUAGE_MARKER}"), (2, 6, None, None), (3, 0, "user", "b"), (None, 3, "system", "n")]
    long = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = lambda df: sorted(((r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()), key=str)
    fresh = [(1, -1, "system", "new"), (1, 0, "user", "a"), (1, 1, "system", "s"), (2, 5, "system", f"new\nx {C.LANGUAGE_MARKER}"), (2, 6, None, None),
             (3, -1, "system", "new"), (3, 0, "user", "b"), (None, 3, "system", "new\nn")]
    assert got(turns.upsert_system(long, F.lit("new"))) == sorted(fresh, key=str)
    more = [(1, -1, "system", C.LANGUAGE_PROMPT), (3, -1, "system", C.LANGUAGE_PROMPT), (None, 2, "system", C.LANGUAGE_PROMPT)]
    assert got(turns.ensure_language(long, F.lit(True))) == sorted(rows + more, key=str)
    assert got(turns.without_system(long)) == [(1, 0, "user", "a"), (3, 0, "user", "b")]


def test_recent_history_limits_before_the_shuffle(spark):
    long = spark.range(100).select((F.col("id") % 3).alias("conv_id"), F.col("id").alias("turn"))
    plan = readers.recent_history(long)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


RAW = {
    '{"decision":"allow","reasons":["a","a"]}': ("allow", ["a"]), "json: {\"decision\": \"BLOCK\", \"reasons\": []}": ("block", []), '﻿{"decision":"allow"}': ("allow", []),
    '{"decision":"block","reasons":["a",],}': ("block", ["a"]), "{“decision”: “block”, “reasons”: [“x”]}": ("block", ["x"]), "well {\"decision\":\"allow\",\"reasons\":[]} ok": ("allow", []),
    "{'decision': 'block', 'reasons': ['q']}": ("block", ["q"]), '{"decision":"perhaps","reasons":["z"]}': ("block", ["invalid_decision_value", "z"]), '{"decision":"allow","reasons":"one"}': ("allow", ["one"]),
    '{"a":1} then {"decision":"allow"}': ("allow", []), "```json\n{\"decision\":\"allow\"}\n```": ("block", ["invalid_json_output"]), "nonsense": ("block", ["invalid_json_output"]), "[1,2]": ("block", ["invalid_json_output"]),
    "   ": ("block", ["empty_response"]), "": ("block", ["empty_response"]),
}


def test_verdict_recovery(spark, column):
    got = column(list(RAW), V.recover_verdict_json)
    assert [(v.decision, list(v.reasons)) for v in got] == list(RAW.values())
    assert column([None], V.recover_verdict_json)[0].reasons == ["empty_response"]
    rows = spark.createDataFrame(list(enumerate([*RAW, None])), "id int, raw string")
    told = [r.verdict for r in V.recover_verdicts(rows, F.col("raw")).orderBy("id").collect()]
    assert [(v.decision, list(v.reasons)) for v in told] == [*RAW.values(), ("block", ["empty_response"])]


def test_salvage_skips_braces_in_strings():
    assert salvage_object('x {"a": "}{"} y') == '{"a": "}{"}'
    assert salvage_object("{broken") is None and salvage_object("") is None and salvage_object("{1,2}") is None


def test_line_verdicts(spark):
    df = spark.createDataFrame([(0, '[{"line":2,"risk":"risky","reasons":["b","a"]},{"line":1,"risk":"safe"}]', None), (1, 'text [{"line":1,"risk":"safe","reasons":[]},] tail', None), (2, "{broken", None), (3, None, "timeout"), (4, None, None)],
                               "id int, raw string, status string")
    got = df.select("id", V.line_verdict_summary(V.recover_line_verdicts(F.col("raw"), F.lit("x\n\ny"), F.col("status"))).alias("s")).orderBy("id").collect()
    assert [(r.s.decision, list(r.s.reasons), list(r.s.risky_lines)) for r in got] == [
        ("block", ["a", "b"], [2]), ("allow", [], []), ("block", ["json_parse_error"], [1, 2, 3]), ("block", ["llm_timeout"], [1, 2, 3]), ("block", ["llm_error"], [1, 2, 3])]


def test_attack_labels(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.1, 0.8, 0.1]), (2, [0.1, 0.2, 0.7]), (3, [0.0, 0.0, 0.1, 0.9]), (4, None), (5, [])], "id int, p array<double>")
    rows = df.select("id", V.attack_label(F.col("p")).alias("l")).orderBy("id").collect()
    assert [(r.l.safe, r.l.label, r.l.reason) for r in rows] == [(True, "SAFE", None), (False, "UNSAFE", "jailbreak"), (False, "UNSAFE", "injection"), (False, "UNSAFE", "unsafe_class_3"),
                                                                 (False, "ERROR", "model_not_loaded"), (False, "ERROR", "model_not_loaded")]
    acts = df.select("id", V.attack_action(V.attack_label(F.col("p"))).alias("a")).orderBy("id").collect()
    assert [r.a.action for r in acts] == ["allow"] + ["block"] * 5


def test_scanner_spans(column):
    raw = '{"findings":[{"span":{"start":0,"end":2},"label":"L","match":"ab"},{"start":1,"end":9}],"spans":[{"start":1,"end":2,"type":"T","value":"b"},{"start":-1,"end":1}],"matches":null}'
    (got,) = column(["abc"], lambda t: V.normalize_scanner_spans(F.lit(raw), t))
    assert [tuple(s) for s in got] == [(1, 2, "T", "b"), (0, 2, "L", "ab")]


def test_model_block_message(spark):
    row = spark.range(1).select(V.build_model_block_message(F.array(F.lit("b"), F.lit("a"), F.lit("b")), {"message_id": F.lit("m1"), "user_id": F.lit("")}, "guide").alias("a"),
                                V.build_model_block_message(F.array().cast("array<string>"), None, "guide").alias("b")).first()
    assert row.a == "guide\n\n차단 원인: a, b\n\n참고: message_id=m1" and row.b == "guide\n\n차단 원인: unspecified"
