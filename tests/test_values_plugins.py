import json

import pytest

from spanloom.functions import values as V
from spanloom.sources import plugins as P


def test_states():
    assert V.flattened({"a": {"b": [1, {}]}, "c": None}) == {"a.b[0]": 1, "a.b[1]": {}, "c": None} and V.flattened(3) == {"": 3}
    assert V.state_match({"a": 1, "b": 0}, {"a": 1, "b": False}) == 0.5 and V.state_match({}, {}) == 1.0
    start = {"a": {"x": 1}, "l": [1]}
    got, errors = V.applied(start, [{"op": "set", "path": "a.y.z", "value": 2}, {"op": "delete", "path": "a.x"}, {"op": "append", "path": "l", "value": 2}, {"op": "append", "path": "n", "value": 1}, {"op": "delete", "path": "q.r"}, {"op": "jump", "path": "a"}])
    assert got == {"a": {"y": {"z": 2}}, "l": [1, 2], "n": [1]} and errors == ["4: KeyError", "5: unknown op"] and start == {"a": {"x": 1}, "l": [1]}


@pytest.mark.parametrize("text, want", [('say {"a": [1]} ok', {"a": [1]}), ("{x} then [2]", [2]), ("none", None), ("", None)])
def test_json_in_prose(text, want):
    assert V.json_in(text) == want


@pytest.mark.parametrize("text, want", [('{"a": 1}', {"a": 1}), ('"{\\"a\\": 1}"', {"a": 1}), ("```json\n{'a': 1,}\n```", {"a": 1}), ('{"a": 1,}', {"a": 1}), ("x", None), (5, None), ("[1]", None)])
def test_arguments_are_repaired(text, want):
    assert V.repaired_arguments(text) == want


def test_tools_and_transcripts():
    assert V.tool_set([]) == [] and V.tool_set("{cut") is None and [t["name"] for t in V.tool_set('["f", {"function": {"name": "g"}}]')] == ["f", "g"]
    assert V.transcript_turn('hi <tool_call>{"name": "f", "arguments": "{\'x\': 1}"}</tool_call>') == ("hi", [{"name": "f", "arguments": {"x": 1}}], None)
    assert V.transcript_turn("<tool_call>oops") == (None, [], "unreadable_call")


def parse(name, data):
    for i, line in enumerate(data.decode().splitlines()):
        if line == "boom":
            raise ValueError(f"line {i} of 'x'")
        yield {"id": f"{name}{i}", "steps": [{"source": "user", "message": line, "tool_calls": None}], "covers": [f"{name}#{i}"]} if line != "odd" else {"id": 5}


def test_parser_plugins(spark):
    f = spark.createDataFrame([("a", bytearray(b"one\nodd\ntwo")), ("b", bytearray(b"x\nboom\ny")), ("c", bytearray(b"boom"))], "path string, content binary")
    rec = spark.createDataFrame([("a#0",), ("a#1",), ("a#2",), ("b#0",), ("b#2",)], "record_id string")
    good, errors, orphans = P.parse_report(P.run_parser(f, parse), rec)
    assert sorted(r.traj_id for r in good.collect()) == ["a0", "a2", "b0"] and sorted(r.record_id for r in orphans.collect()) == ["a#1", "b#2"]
    assert {(r.cause, r.n) for r in errors.collect()} == {("contract: no id", 1), ("ValueError: line N of STR", 2)}
    assert [r.message for r in P.steps(good).orderBy("traj_id").collect()] == ["one", "two", "x"]
    assert json.loads(good.first().trajectory)["id"]
