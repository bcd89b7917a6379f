"""Request templates, contexts of sessions, and agent responses."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as E
from salesmatch.operators import requests, sessions, templates
from salesmatch.operators.templates import Line, Ranked, Template
from salesmatch.plans import q_requests, q_templates

SF = "/root/testdata/sf0.001"
ROW = "k long, name string, n int, tags array<string>, ranked array<struct<make:string,price:long>>, note string"


def compiled(spark, lines, *row):
    df = spark.createDataFrame([(1, *row)], ROW)
    return templates.requests_of(df, Template("t", "s", tuple(lines)), "k").first().request


def test_null_fields_keep_their_line(spark):
    lines = [Line("Head"), Line("Name: ", "name"), Line("N: ", "n", "none", tail=" km"), Line("Tags: ", "tags"), Line("Note: ", "note", None),
             Ranked("ranked", ("", "make", " at ", "price"), 2)]
    assert compiled(spark, lines, None, None, None, None, None) == "Head\nName: -\nN: none km\nTags: -\n-"
    assert compiled(spark, lines, "", 1234, ["", None], [], "") == "Head\nName: -\nN: 1,234 km\nTags: -\n-"
    full = compiled(spark, lines, "é", 0, ["a", None, "b"], [("x", 1), (None, None), ("z", 3)], "n" * 5)
    assert full == "Head\nName: é\nN: 0 km\nTags: a, b\nNote: nnnnn\n1. x at 1\n2. - at -"


def test_lists_are_joined_and_texts_cut(spark):
    lines = [Line("T: ", "tags", sep=" / "), Line("C: ", "note", None, cut=3), Ranked("ranked", ("", "make"), 9, numbered="No. {n}: ", missing=None)]
    assert compiled(spark, lines, None, None, ["a", "b"], None, "日本語です") == "T: a / b\nC: 日本語"
    assert compiled(spark, lines, None, None, None, [("x", 1)], "ab") == "T: -\nC: ab\nNo. 1: x"


def test_templates_have_every_branch_in_the_tables(spark):
    got = [r.request for r in E.queries()["request_talk_script"](spark, SF).collect()]
    for part in ("万円): ", "円): line ", "): -", "The customer said: ", "Budget from: 0 yen", "Budget to: 99,999,999 yen", "Cares about: -",
                 "Cares about: space, price", "Talk:\n", "Family: -", "Age: -"):
        assert any(part in x for x in got), part
    assert any("Talk:" not in x for x in got) and all("Vehicles by rank:" in x for x in got)
    talks = [x.split("Talk:\n")[1].split("\nVehicles by rank:")[0] for x in got if "Talk:\n" in x]
    assert max(map(len, talks)) == q_templates.TRANSCRIPT_CHARS
    app = [r.request for r in E.queries()["request_app_insight"](spark, SF).collect()]
    assert any("Likes: none" in x for x in app) and any("Age: unknown" in x for x in app)


def test_a_template_is_one_projection(spark):
    df = spark.createDataFrame([(1, "a", 1, ["x"], [("m", 1)], "n")], ROW)
    plan = templates.requests_of(df, Template("t", "s", (Line("N: ", "name"), Ranked("ranked", ("", "make"), 2))), "k")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Project") <= 2 and "Join" not in text and "Aggregate" not in text


def test_sessions_without_a_customer_keep_their_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "user", "c")], "session_id long, turn long, role string, content string")
    ctx = spark.createDataFrame([(1, "known"), (3, "silent")], "session_id long, context string")
    got = sessions.with_context(turns, sessions.default_contexts(turns, ctx, "default"), "context").collect()
    assert sorted((r.session_id, r.turn, r.content) for r in got) == [
        (1, -1, "known"), (1, 0, "a"), (2, -1, "default"), (2, 0, "b"), (2, 1, "c"), (3, -1, "silent")]
    kinds = {("Customer in view" in r.content) for r in E.queries()["session_requests"](spark, SF).where("turn = -1").collect()}
    assert kinds == {True, False}


def fold(spark, *responses):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(responses)], "id long, r string")
    return sorted(requests.fold_responses(df, "r", q_requests.OUTPUT_RULES).collect(), key=lambda r: r.id)


def item(*texts, role="assistant", kind="message"):
    return {"type": kind, "role": role, "content": [{"type": "output_text", "text": t} for t in texts]}


def test_response_fold(spark):
    first, second, third, cut, none, other, tools = fold(
        spark, {"output": [item("A first"), item("<name>manuals</name> x"), item("", None, "The last"), item(role="assistant")]},
        {"output": [item("see SalesBook"), item(" <name>WebSearch"), item("<name>other</name>"), item("<b>"), item("x", role="user")]},
        {"output": [{"type": "message", "role": "assistant", "content": [{"type": "reasoning", "text": "no"}, {"type": "output_text", "text": "yes"}]}]},
        '{"output": [{"type": "mess', None, {"output": [], "choices": [{"message": {"content": "else"}}]},
        {"output": [{"type": "function_call"}, {"type": None, "role": None, "content": None}]})
    assert (first.ok, first.progress, first.final_answer) == (True, ["Reading the manuals..."], "The last")
    assert second.progress == ["Reading the sales records...", "Searching the web...", "Asking another agent..."]
    assert second.last_progress == "Asking another agent..." and second.final_answer == ""
    assert third.final_answer == "yes" and third.n_progress == 0 and third.last_progress is None
    assert (cut.ok, none.ok, cut.final_answer, none.final_answer, cut.progress) == (False, False, "", "", [])
    assert other.final_answer == "else" and tools.progress == [requests.TOOL_MESSAGE]


def test_responses_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "{}")], "id long, r string")
    plan = requests.fold_responses(df, "r", q_requests.OUTPUT_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_every_output_rule_fires_in_the_tables(spark):
    lines = E.queries()["agent_responses"](spark, SF).select(F.explode(F.split("progress", " / ")).alias("p")).distinct().collect()
    assert {r.p for r in lines} - {""} == {r.message for r in q_requests.OUTPUT_RULES} | {requests.TOOL_MESSAGE}
    answers = E.queries()["agent_responses"](spark, SF).select("ok", F.col("final_answer").substr(1, 4).alias("a")).distinct().collect()
    assert {(r.ok, r.a) for r in answers} >= {(True, "Take"), (True, "<b>l"), (True, "Othe"), (True, ""), (False, "")}
