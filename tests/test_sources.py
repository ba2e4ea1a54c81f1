import json

from spanloom.sources import records as R
from spanloom.sources import spans as P
from tests.conftest import SMALL


def rec(spark, *values):
    return spark.createDataFrame([("f", i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "file string, pos int, record string")


def by_id(df):
    return {r.span_id: r for r in df.collect()}


def test_split_json_keeps_lines_and_names_what_is_broken():
    text = '{"a": 1}\n\n{"b": "x\u2028y"}\n{"cut": \nmore\n{"c":\n 3} {"d": 4}\n[{"e": 5}, 6]\n{"tail'
    assert list(R.split_json(text)) == [
        (1, '{"a": 1}', None), (3, '{"b": "x\u2028y"}', None), (4, None, "malformed_json: lines 4 to 5"), (6, '{"c":\n 3}', None), (7, '{"d": 4}', None), (8, '{"e": 5}', None), (8, "6", None), (9, None, "malformed_json: line 9"),
    ]
    assert list(R.split_json("  \n")) == []


def test_mixed_folder(spark, tmp_path):
    d = tmp_path / "logs"
    (d / ".git").mkdir(parents=True)
    (d / "a.jsonl").write_bytes(b'\xef\xbb\xbf{"x": 1}\n{"x": \xff"}\n')
    (d / "b.csv").write_text("k,v\n1,one\n2\n")
    (d / "c.txt").write_text("first\n\nthird\n")
    (d / "d.bin").write_bytes(b"\0\1\2")
    (d / "e.json").write_text('[{"y": 1}, {"y": 2}]')
    (d / ".hidden.txt").write_text("no")
    (d / ".git" / "x.txt").write_text("no")
    x = R.record_ids(R.read_records(spark, str(d)))
    got = sorted((r.record_id, r.line, json.loads(r.record)) for r in x.where("record is not null").collect())
    assert got == sorted([("a.jsonl#0", 1, {"x": 1}), ("b.csv#0", 2, {"k": "1", "v": "one"}), ("b.csv#1", 3, {"k": "2", "v": None}), ("c.txt#0", 1, {"text": "first"}), ("c.txt#1", 3, {"text": "third"}), ("d.bin#0", None, {"bytes": 3}), ("e.json#0", 1, {"y": 1}), ("e.json#1", 1, {"y": 2})], key=lambda t: (t[0],))
    assert sorted(r.issue for r in x.where("issue is not null").collect()) == ["invalid_utf8: 1 bytes replaced", "malformed_json: line 2"]
    assert [r.file.rpartition("/")[2] for r in R.files(spark, str(d)).collect()] == ["a.jsonl", "b.csv", "c.txt", "d.bin", "e.json"]
    assert R.json_lines(spark, str(d / "a.jsonl")).where("readable").count() == 1


def test_detection(spark):
    values = {"otlp": {"resourceSpans": []}, "flat_spans": {"trace_id": "t", "span_id": "s", "attributes": {}}, "langfuse": {"id": "t", "observations": []}, "langsmith": {"id": 1, "run_type": "llm"}, "session_log": {"sessionId": "s", "type": "user", "message": {}}, "chat": {"messages": []}, "phoenix": {"context": {"trace_id": "t", "span_id": "s"}}}
    rows = [(k, i, json.dumps(v)) for k, v in values.items() for i in range(3)] + [("mixed", 0, '{"resourceSpans": []}'), ("mixed", 1, '{"messages": []}'), ("odd", 0, '{"z": 1}'), ("session_log", 3, '{"type": "summary", "summary": "x"}')]
    got = {r.file: r.source for r in R.detected(spark.createDataFrame(rows, "file string, pos int, record string")).collect()}
    assert got == {**{k: k for k in values}, "mixed": None, "odd": None}


def test_flat_spans_of_the_test_table(spark):
    from pyspark.sql import functions as F

    t = spark.read.parquet(f"{SMALL}/traces.parquet").where(F.try_parse_json("attributes").isNotNull())
    r = t.select(F.col("file_name").alias("file"), F.col("delivery_id").cast("int").alias("pos"), F.to_json(F.struct("trace_id", "span_id", "parent_span_id", F.col("span_name").alias("name"), "start_time", "end_time", F.parse_json("attributes").alias("attributes"))).alias("record"))
    x = P.flat(r)
    assert x.count() == t.count() and x.where("start_ns is null").count() == 0
    assert {v.role for v in x.select("role").distinct().collect()} <= {"model", "tool", "none"}


def test_otlp(spark):
    span = lambda i, p=None, **k: {"traceId": "aa", "spanId": i, "parentSpanId": p, "name": i, "startTimeUnixNano": "1700000000000000001", "endTimeUnixNano": 1700000000000000009, **k}
    a = lambda k, **v: {"key": k, "value": v}
    r = {"resourceSpans": [None, {"resource": {"attributes": [a("x", stringValue="res"), a("n", intValue="5")]}, "scopeSpans": [7, {"scope": {"name": "sc"}, "spans": [None, span("1", "0000", attributes=[a("x", stringValue="own"), a("l", arrayValue={"values": [{"intValue": "1"}, {"boolValue": False}]}), a("gen_ai.operation.name", stringValue="chat")], status={"code": 2}), span("2", "1", startTimeUnixNano="0", attributes=[a("openinference.span.kind", stringValue="EVALUATOR")])]}]}]}
    x = by_id(P.otlp(rec(spark, r, "{cut", None, [])))
    assert set(x) == {"1", "2"} and json.loads(x["1"].attributes) == {"otel.scope.name": "sc", "x": "own", "n": 5, "l": [1, False], "gen_ai.operation.name": "chat"}
    assert (x["1"].parent_span_id, x["1"].start_ns, x["1"].error, x["1"].role, x["1"].label) == (None, 1700000000000000001, True, "model", "gen_ai.operation.name=chat")
    assert (x["2"].parent_span_id, x["2"].start_ns, x["2"].role) == ("1", None, "excluded")
    assert {(i.kind) for i in P.issues(P.otlp(rec(spark, r))).collect()} == {"no_start"}


def test_native_formats(spark):
    lf = by_id(P.langfuse(rec(spark, {"id": "t", "observations": [{"id": "a", "type": "SPAN", "startTime": "2026-01-01T00:00:00.5Z", "children": [{"id": "b", "type": "GENERATION", "level": "ERROR", "startTime": "2026-01-01T00:00:01+01:00"}]}, {"id": "c", "type": "EVALUATOR", "parentObservationId": "a"}]})))
    assert {k: (v.trace_id, v.parent_span_id, v.role, v.error) for k, v in lf.items()} == {"a": ("t", None, "step", None), "b": ("t", "a", "model", True), "c": ("t", "a", "excluded", None)}
    assert lf["b"].start_ns == lf["a"].start_ns - 3_599_500_000_000
    ls = by_id(P.langsmith(rec(spark, {"runs": [{"id": "r", "run_type": "chain", "child_runs": [{"id": "k", "run_type": "tool", "error": "x", "child_runs": [{"run_id": "m", "run_type": "llm"}]}]}]})))
    assert {k: (v.parent_span_id, v.role, v.error) for k, v in ls.items()} == {"r": (None, "step", False), "k": ("r", "tool", True), "m": ("k", "model", False)}
    ph = by_id(P.phoenix(rec(spark, {"data": [{"context": {"trace_id": "t", "span_id": "p"}, "span_kind": "llm", "parent_id": "q", "attributes": {"a": 1}, "status_code": "ERROR"}]})))
    assert (ph["p"].role, ph["p"].parent_span_id, ph["p"].error, json.loads(ph["p"].attributes)["a"]) == ("model", "q", True, 1)
    st = by_id(P.span_tree(rec(spark, {"trace_id": "t", "spans": [{"span_id": "1", "span_name": "n", "timestamp": "2026-01-01T00:00:00Z", "duration": "PT1M2.5S", "child_spans": [{"span_id": "2", "duration": "P"}]}]})))
    assert st["1"].end_ns - st["1"].start_ns == 62_500_000_000 and st["2"].parent_span_id == "1" and st["2"].end_ns is None
    deep = {"trace_id": "t", "spans": [{"span_id": "0", "child_spans": []}]}
    at = deep["spans"][0]
    for i in range(1, 300):
        at["child_spans"].append({"span_id": str(i), "child_spans": []})
        at = at["child_spans"][0]
    assert P.span_tree(rec(spark, deep)).count() == 300


def test_session_events_pair(spark):
    e = lambda i, t, kind, **p: {"id": i, "ts": f"2026-01-01T00:00:0{t}Z", "event_type": kind, "payload": p}
    r = {"schema_version": "2", "session_id": "s", "events": [e("1", 1, "tool_call", call_id="a"), e("2", 2, "tool_result", call_id="a"), e("3", 3, "tool_call", call_id="b"), e("4", 3, "tool_result", correlation_id="c"), e("5", 4, "tool_call", correlation_id="d"), e("6", 3, "tool_result", correlation_id="d"), e("7", 5, "tool_call", call_id="x"), e("8", 5, "tool_call", call_id="x"), e("9", 6, "tool_result", call_id="x"), e("10", 6, "note")]}
    got = {r.key: r.status for r in P.paired_events(P.session_events(rec(spark, r))).collect()}
    assert got == {"a": "paired", "b": "open", "c": "stray", "d": "reversed", "x": "ambiguous"}


def test_empty(spark):
    assert all(read(rec(spark)).count() == 0 for read in P.READERS.values())
