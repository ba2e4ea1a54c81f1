import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import ingest as I
from spanloom.operators import messages as M
from spanloom.operators import trees as T
from spanloom.operators import workflow as X

SPAN = "trace_id string, span_id string, parent_span_id string, role string, name string"


def flat(t, s, p=None, **a):
    return json.dumps({"trace_id": t, "span_id": s, "parent_span_id": p, "name": s, "start_time": "2026-01-01T00:00:00Z", "end_time": "2026-01-01T00:00:01Z", "attributes": a})


def test_corpus_is_accounted_for(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.jsonl").write_text("\n".join([flat("t", "1"), flat("t", "2", "1", **{"gen_ai.operation.name": "chat", "gen_ai.completion": "x"}), flat("t", "2", "1"), "{cut", flat("t", "3", "4"), flat("t", "4", "3"), flat(None, "5")]))
    (d / "b.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "u", "spanId": "1", "startTimeUnixNano": "5", "attributes": [{"key": "openinference.span.kind", "value": {"stringValue": "CHAIN"}}]}]}]}]}))
    (d / "c.json").write_text('{"what": 1}')
    c = I.load_corpus(spark, str(d))
    assert I.accounted(c)
    assert {r.bucket: r.n for r in I.report(c).collect()} == {"unrepresented": 1, "model": 1, "duplicate": 1, "cyclic": 2, "malformed": 1, "pipeline_step": 1}
    kinds = {r.kind: r.n for r in I.issue_counts(c).collect()}
    assert kinds == {"malformed_json": 1, "duplicate_span": 1, "cyclic_span": 2, "no_trace_id": 1, "unknown_source": 1}
    assert {r.rule for r in I.health(c.spans).collect()} == {"no_model_has_input", "span_without_end"}
    assert I.load_corpus(spark, str(d / "c.json")).spans.count() == 0


parents = st.lists(st.integers(-1, 12), min_size=1, max_size=12)


@settings(max_examples=12, deadline=None)
@given(st.lists(parents, min_size=1, max_size=4))
def test_lineage_against_walking(spark, forest):
    rows = [(f"t{k}", str(i), None if p < 0 else str(p), "step" if i % 3 else "model", "") for k, ps in enumerate(forest) for i, p in enumerate(ps)]
    got = {(r.trace_id, r.span_id): (r.root_id, r.depth, r.cyclic, r.flag) for r in T.lineage(spark.createDataFrame(rows, SPAN), {"flag": F.col("role") == "model"}).collect()}
    for k, ps in enumerate(forest):
        for i in range(len(ps)):
            at, seen, flag = i, [], False
            while at not in seen and 0 <= ps[at] < len(ps):
                seen.append(at)
                at = ps[at]
                flag |= at % 3 == 0
            if at in seen:
                assert got[f"t{k}", str(i)][2]
            else:
                assert got[f"t{k}", str(i)] == (str(at), len(seen), False, flag)


def test_steps_shapes_and_wrappers(spark):
    s = spark.createDataFrame([("t", "a", None, "step", "A"), ("t", "b", "a", "step", "B"), ("t", "c", "b", "model", "C"), ("t", "d", "a", "step", "D"), ("t", "e", "d", "step", "E"), ("u", "a", None, "step", "A"), ("u", "d", "a", "step", "D"), ("u", "e", "d", "step", "E"), ("u", "b", "a", "step", "B"), ("u", "c", "b", "model", "C"), ("u", "c2", "b", "model", "C"), ("v", "x", "gone", "none", "X")], SPAN)
    assert {(r.trace_id, r.span_id) for r in T.pipeline_steps(s).collect()} == {("t", "d"), ("u", "d")}
    assert {(r.trace_id, r.span_id): r.bucket for r in T.bucketed(s).collect() if r.trace_id == "t"} == {("t", "a"): "container", ("t", "b"): "container", ("t", "c"): "model", ("t", "d"): "pipeline_step", ("t", "e"): "covered"}
    ids = {r.trace_id: r.shape_id for r in T.shapes(s, F.col("name")).collect()}
    assert ids["t"] == ids["u"] != ids["v"]
    assert [(r.traces, r.example) for r in T.shape_stats(s, F.col("name")).collect()] == [(2, "t"), (1, "v")]
    w = spark.createDataFrame([("t", "o", None, "model", "m", "ok", 0, 10_000_000), ("t", "i", "o", "model", "m", "ok", 10, 9_999_990), ("t", "k", "i", "tool", None, "ok", 20, 30), ("t", "p", None, "model", "m", "ok", 0, 10), ("t", "q", "p", "model", "n", "ok", 0, 10)], "trace_id string, span_id string, parent_span_id string, role string, model string, status string, start_us bigint, end_us bigint")
    assert {(r.span_id, r.parent_span_id) for r in T.collapsed_wrappers(w).collect()} == {("i", None), ("k", "i"), ("p", None), ("q", "p")}


def test_messages_from_every_place(spark):
    f = lambda a, e=None: [(d, r, c, w) for d, _, r, c, _, _, w, _ in M.span_messages(a, e)]
    assert f({"gen_ai.prompt.0.role": "system", "gen_ai.prompt.0.content": "s", "gen_ai.prompt.1.role": "user", "gen_ai.prompt.1.content": "q", "gen_ai.completion": "a"}) == [("input", "system", "s", "gen_ai.prompt.N"), ("input", "user", "q", "gen_ai.prompt.N"), ("output", "assistant", "a", "gen_ai.completion")]
    assert f({"llm.input_messages.0.message.role": "user", "llm.input_messages.0.message.content": "q", "output.value": '{"choices": [{"message": {"role": "assistant", "content": "a"}}]}'}) == [("input", "user", "q", "llm.input_messages.N"), ("output", "assistant", "a", "output.value")]
    assert f({"gen_ai.input.messages": '[{"role": "user", "content": "q"}]', "input.value": "other"}) == [("input", "user", "q", "gen_ai.input.messages")]
    assert f({}, [{"name": "gen_ai.user.message", "attributes": {"content": "q"}}, {"name": "gen_ai.choice", "attributes": {"content": "a"}}]) == [("input", "user", "q", "events"), ("output", "assistant", "a", "events")]
    assert M.span_messages({"input.value": '{"cut'}) == [("input", 0, None, None, None, None, None, True)]
    assert f({"input.value": "[see] note"}) == [("input", "user", "[see] note", "input.value")]
    df = spark.createDataFrame([("t", "s", json.dumps({"input.value": json.dumps([{"role": "user", "content": "1"}, {"role": "assistant", "content": "2"}, {"role": "user", "content": "3"}])})), ("t", "n", None)], "trace_id string, span_id string, attributes string")
    assert [(r.n, r.text) for r in M.new_user_turns(M.normalised(df), df).collect()] == [(2, "3")]


def test_requests_tasks_and_fields(spark):
    c = spark.createDataFrame([("a", "1", "x"), ("b", "1", None), ("b", "2", " x "), ("c", "1", "x"), ("c", "2", "x"), ("d", "1", "x"), ("d", "2", "y"), ("e", "1", ""), ("e", "2", None)], "trace_id string, span_id string, task string")
    assert {r.trace_id: (r.span_id, r.task, r.how) for r in X.chosen_invocation(c).collect()} == {"a": ("1", "x", "sole"), "b": ("2", "x", "only_resolving"), "c": ("1", "x", "agreement"), "d": (None, None, "conflict"), "e": (None, None, "no_task")}
    m = spark.createDataFrame([("e", "user", "hello", 1), ("e", "user", "later", 2), ("d", "user", "no", 1)], "trace_id string, role string, content string, order int")
    assert {r.trace_id: (r.task, r.source) for r in X.resolved_task(c, m).collect()} == {"a": ("x", "declared"), "b": ("x", "declared"), "c": ("x", "declared"), "d": (None, "conflict"), "e": ("hello", "first_user_message")}
    j = spark.createDataFrame([(1, '{"q": {"query": "a"}, "l": [{"x": 1}, "{\\"y\\": true}"], "n": null}'), (2, '{"q": {"query": "b"}}'), (3, "{cut"), (4, None)], "id int, j string")
    assert {(r.id, r.path, r.value) for r in X.leaves(j, ["id"], "j").collect()} == {(1, "$.q.query", "a"), (1, "$.l[].x", "1"), (1, "$.l[].y", "true"), (2, "$.q.query", "b")}
    assert [(r.path, r.records) for r in X.field_options(j, "id", "j", ["query", "input"]).collect()][0] == ("$.q.query", 2)


def test_evidence(spark):
    long = "the stock of item 5512 is seven pieces in hall B"
    calls = spark.createDataFrame([("t", "c1", long, 10), ("t", "c2", long, 11), ("t", "c3", "42", 12), ("t", "c4", "7", 12)], "trace_id string, span_id string, output string, end_ns bigint")
    targets = spark.createDataFrame([("t", "m1", f"I see that {long}.", 20), ("t", "m2", "42", 20), ("t", "m3", "it is 7", 20), ("t", "m0", long, 5), ("u", "m1", long, 50)], "trace_id string, span_id string, text string, start_ns bigint")
    got = {(r.call_span_id, r.target_span_id): (r.kind, r.basis, r.shared_with) for r in X.text_links(calls, targets).collect()}
    assert got == {("c1", "m1"): ("shared_result", "contained", 1), ("c2", "m1"): ("shared_result", "contained", 1), ("c3", "m2"): ("text_match", "whole_leaf", 0)}
    assert {(r.kind, r.links, r.traces, r.most) for r in X.link_counts(X.text_links(calls, targets)).collect()} == {("shared_result", 2, 1, 2), ("text_match", 1, 1, 1)}
    asks = spark.createDataFrame([("t", "m1", 1, 0, "f"), ("t", "m1", 1, 1, "f"), ("t", "m2", 9, 0, "g")], "trace_id string, span_id string, at int, n int, name string")
    tools = spark.createDataFrame([("t", "x", 2, "f"), ("t", "y", 3, "f"), ("t", "z", 10, "f"), ("t", "w", 11, "g")], "trace_id string, span_id string, at int, name string")
    assert {(r.ask_span_id, r.n, r.tool_span_id) for r in X.executed_between(asks, tools).collect()} == {("m1", 0, "x"), ("m1", 1, "y"), ("m2", 0, "w")}
    nodes = spark.createDataFrame([("t", "a", "p", 1), ("t", "b", "p", 1), ("t", "c", "p", 2), ("t", "d", "p", None)], "trace_id string, span_id string, parent_span_id string, round int")
    assert [(r.call_span_id, r.target_span_id) for r in X.same_round_links(nodes).collect()] == [("b", "a")]
    h = spark.createDataFrame([("t", "1", "first", 1), ("t", "1", "again", 2), ("t", "2", "x", 1)], "trace_id string, call_id string, output string, order int")
    assert [(r.call_id, r.output) for r in X.recovered_results(h, h.where("call_id = '2'")).collect()] == [("1", "first")]
