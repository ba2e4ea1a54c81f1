import json

import pytest

from spanloom.sources import chat as C


def rec(spark, *values):
    return spark.createDataFrame([("f", i, json.dumps(v)) for i, v in enumerate(values)], "file string, pos int, record string")


@pytest.mark.parametrize("wrap", [lambda m: m, lambda m: {"messages": m}, lambda m: {"conversation": m}, lambda m: [{"chat": m}], lambda m: {"conversations": [m]}])
def test_wrappers(wrap):
    m = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    assert C.conversations(wrap(m)) == [m]


def test_message_shapes():
    n = lambda m: C.normal_message(m)[:4]
    assert n({"from": "human", "value": "hi"}) == ("user", "hi", [], None)
    assert n({"role": "model", "parts": [{"text": "a"}, {"functionCall": {"name": "f", "args": {"x": 1}}}]}) == ("assistant", "a", [{"id": None, "name": "f", "arguments": {"x": 1}}], None)
    assert n({"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": '{"x": 1}'}}]}) == ("assistant", None, [{"id": "1", "name": "f", "arguments": {"x": 1}}], None)
    assert n({"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "ok"}]}]}) == ("tool", "ok", [], "1")
    assert n({"type": "ai", "data": {"content": "x"}}) == ("assistant", "x", [], None)
    assert n({"from": "function_call", "value": '{"name": "f", "arguments": {"y": 2}}'}) == ("assistant", None, [{"id": None, "name": "f", "arguments": {"y": 2}}], None)
    assert n({"role": "assistant", "function_call": {"name": "f", "arguments": "{cut"}})[2] == [{"id": None, "name": "f", "arguments": {"_text": "{cut"}}]
    assert C.normal_message({"role": "alien", "content": "x"})[6] == "unknown_role: alien"
    assert C.normal_message({"role": "user", "content": [{"type": "hologram"}]})[6] == "unknown_block: hologram"
    assert C.normal_message(5)[6] == "not_an_object"


def call(*ids, name="f"):
    return {"role": "assistant", "content": "", "tool_calls": [{"id": i, "function": {"name": name, "arguments": "{}"}} for i in ids]}


def test_calls_pair_by_id_name_and_place(spark):
    by_id = [{"role": "user", "content": "q"}, call("1", "2"), {"role": "tool", "tool_call_id": "2", "content": "two"}, {"role": "tool", "tool_call_id": "9", "content": "stray"}]
    by_name = [call(None, name="a"), {"role": "function", "name": "a", "content": "r1"}, call(None, name="a"), call(None, name="b"), {"role": "function", "name": "a", "content": "r2"}]
    by_place = [call(None, None), {"role": "tool", "content": "p1"}, {"role": "tool", "content": "p2"}]
    m = C.messages(rec(spark, by_id, by_name, by_place, {"z": 1}))
    got = {(r.pos, r.call_idx, r.n): (r.output, r.matched) for r in C.calls(m).collect()}
    assert got == {(0, 1, 0): (None, None), (0, 1, 1): ("two", "id"), (1, 0, 0): ("r1", "name"), (1, 2, 0): ("r2", "name"), (1, 3, 0): (None, None), (2, 0, 0): ("p1", "place"), (2, 0, 1): ("p2", "place")}
    assert [(r.pos, r.call_id) for r in C.stray_results(m).collect()] == [(0, "9")]
    assert [r.issue for r in m.where("pos = 3").collect()] == ["no_conversation"]


def test_turns_and_unanswered(spark):
    m = C.messages(rec(spark, [{"role": "user", "content": "<system-reminder>x</system-reminder>"}, {"role": "user", "content": "one<system-reminder a='b'>\n</system-reminder>"}, {"role": "assistant", "content": "A"}, {"role": "user", "content": "two"}]))
    assert [(r.idx, r.text, r.after_idx) for r in C.turns(m).orderBy("idx").collect()] == [(1, "one", None), (3, "two", 2)]
    assert [r.idx for r in C.unanswered(m).orderBy("idx").collect()] == [0, 3]


def test_session_logs_and_sharegpt(spark):
    line = lambda t, role, c: {"sessionId": "s", "type": role, "timestamp": t, "message": {"role": role, "content": c}}
    m = C.session_messages(rec(spark, line("2", "assistant", [{"type": "tool_use", "id": "1", "name": "f", "input": {}}]), line("1", "user", "q"), line("3", "user", [{"type": "tool_result", "tool_use_id": "1", "content": "r"}]), {"type": "summary", "sessionId": "s"}))
    assert [(r.idx, r.role) for r in m.orderBy("idx").collect()] == [(0, "user"), (1, "assistant"), (2, "tool")]
    assert [(r.output, r.matched) for r in C.calls(m).collect()] == [("r", "id")]
    x = json.loads(C.to_sharegpt(m).first().conversations)
    assert [y["from"] for y in x] == ["human", "function_call", "observation"] and json.loads(x[1]["value"])[0]["id"] == "1"


def test_empty(spark):
    assert C.calls(C.messages(rec(spark))).count() == 0
