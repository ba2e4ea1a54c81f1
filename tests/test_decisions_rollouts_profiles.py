import json

from pyspark.sql import functions as F

from spanloom.operators import profiles as P
from spanloom.operators import rollouts as R
from spanloom.sources import decisions as D


def rec(spark, rows):
    return spark.createDataFrame([("f", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "file string, pos int, record string")


AB = {"a": "yes", "b": "no"}
ROWS = [
    {"id": "1", "question": "q1", "options": AB, "target": "a", "split": "test", "group_id": "g"}, {"id": "2", "question": "q2", "options": AB, "target": {"a": 0.5, "b": 0.5}}, "{cut", [], {"id": "3", "question": " ", "options": {"a": "x"}, "target": "z"},
    {"id": "4", "question": "q4", "options": AB, "target": "a"}, {"id": "5", "question": "q4", "options": AB, "target": "b"}, {"id": "6", "question": "q1", "options": AB, "target": "a"}, {"id": "7", "question": "q7", "options": {str(i): "x" for i in range(27)}, "target": "1"},
    {"id": "8", "question": "q8", "options": AB, "target": {"a": 0.9}}, {"id": "9", "question": "q9", "options": AB, "target": "a", "split": "train", "group_id": "h"}, {"id": "10", "question": "q10", "options": AB, "target": "a", "split": "test", "group_id": "h"}, {"id": "11", "question": "q11", "options": {"b": "no", "a": "yes"}, "target": "b", "split": "train"},
]


def test_import_keeps_or_says_why(spark):
    kept, bad = D.imported(rec(spark, ROWS))
    assert {r.decision_id for r in kept.collect()} == {"1", "2", "11"}
    why = {r.pos: r.reason for r in bad.collect()}
    assert why == {2: "malformed", 3: "not_an_object", 4: "no_question,fewer_than_two_options,target_not_an_option", 5: "conflicting_targets", 6: "conflicting_targets", 7: "repeated_content", 8: "too_many_options", 9: "target_not_a_distribution", 10: "group_in_several_splits", 11: "group_in_several_splits"}
    assert [o.id for o in kept.where("decision_id = '11'").first().options] == ["b", "a"]
    text = kept.where("decision_id = '11'").select(D.prompt()).first()[0]
    assert text == "q11\n\nA. no\nB. yes\n\nAnswer:"
    pred = [{"decision_id": "1", "probabilities": {"a": 0.7, "b": 0.3}}, {"decision_id": "2", "probabilities": {"a": 1.0}}, {"decision_id": "2x", "probabilities": {}}]
    p = D.predictions(rec(spark, pred), kept)
    assert {r.decision_id: r.rejection for r in p.collect()} == {"1": None, "2": "missing_option", "11": "missing"}
    assert {(r.reason, r.n) for r in D.rejection_reasons(p).collect()} == {("missing_option", 1), ("missing", 1)}
    assert {r.split: r.label for r in D.majority(kept.where("split is not null")).collect()}["test"] in ("a", "tie")
    assert {r.id: r.p for r in D.train_prior(kept.where("decision_id = '11'")).collect()} == {"b": 1.0}
    one, two = D.training_order(kept, 1), D.training_order(kept.repartition(3), 1)
    assert sorted(map(str, one.select("decision_id", "order_key", "options").collect())) == sorted(map(str, two.select("decision_id", "order_key", "options").collect()))
    whole, clash = D.merged([kept, kept.where("decision_id = '1'")])
    assert {r.decision_id for r in clash.collect()} == {"1"} and whole.count() == 2
    assert {(r.key, r.value) for r in D.leaked(kept, kept.where("decision_id = '1'"), ["decision_id", "group_id"]).collect()} == {("decision_id", "1"), ("group_id", "g")}
    none, bad = D.imported(rec(spark, []))
    assert none.count() == 0 and bad.count() == 0


def test_histories_and_steps(spark):
    t = spark.createDataFrame([("t", i, r, x, c) for i, (r, x, c) in enumerate([("user", "q", None), ("assistant", "look", "f"), ("tool", "found", None), ("assistant", "a" * 30, "f"), ("user", None, None), ("assistant", "end", None)])], "traj string, pos int, role string, text string, call string")
    got = {r.pos: r.history for r in R.step_rows(t, last=2, head=5, tail=3).collect()}
    assert got == {1: "user: q", 3: "assistant: look\ntool: found", 5: "assistant: aaaaa … aaa\nuser: "}
    assert [(r.pos, r.reply, r.rank) for r in R.search_steps(t, 3).collect()] == [(1, "found", 1)]
    r = spark.createDataFrame([("q1", True, True, 3, "x", True), ("q1", True, False, 5, "I do not know", False), ("q2", False, None, 1, None, True)], "query_id string, ended boolean, correct boolean, turns int, answer string, seen boolean")
    s = R.summary(r).first()
    assert (s.n, s.correct, round(s.abstained, 3), s.correct_if_seen, s.correct_if_unseen) == (3, 0.5, 0.333, 1.0, 0.0)
    c = {x.metric: (x.questions, x.diff) for x in R.compared(r, r.where("query_id = 'q1'"), ["turns"]).collect()}
    assert c == {"turns": (1, 0.0)}


def test_shell_evidence(spark):
    assert R.command_facts("cat a.txt | grep -n x b.txt > out.txt && sed -i s/a/b/ c.txt; cp d e; pip install z; python run.py 2>/dev/null") == [
        (0, "read", "a.txt"), (1, "write", "out.txt"), (1, "read", "b.txt"), (2, "write", "c.txt"), (3, "read", "d"), (3, "write", "e"), (4, "setup", None), (5, "opaque", None),
    ]
    assert R.command_facts("echo 'open") == [(0, "opaque", None)] and R.command_facts("") == []
    calls = spark.createDataFrame([("t", 1, "cat a"), ("t", 2, "touch a b"), ("t", 3, "python x"), ("t", 4, "tee c"), ("t", 5, None)], "traj string, seq int, command string")
    assert {r.path: r.blind for r in R.read_before_write(R.shell_facts(calls)).collect()} == {"a": False, "b": True, "c": False}


def test_profiles(spark):
    leaves = spark.createDataFrame([(i, "$.state", "open" if i % 2 else "done") for i in range(10)] + [(i, "$.id", str(i)) for i in range(10)] + [(0, "$.rare", "x")], "id int, path string, value string")
    assert [r.path for r in P.label_fields(leaves, "id").collect()] == ["$.state"]
    args = spark.createDataFrame([("f", "mode", "ab"[i % 2], i, "string") for i in range(12)] + [("f", "n", str(i), i, "number" if i else "string") for i in range(6)], "tool string, name string, value string, call int, kind string")
    assert [(r.name, r["values"]) for r in P.enumerated_arguments(args).collect()] == [("mode", ["a", "b"])]
    calls = spark.createDataFrame([("f", i) for i in range(12)], "tool string, call int")
    assert [(r.name, r.share) for r in P.optional_arguments(calls, args).collect()] == [("n", 0.5)]
    assert [(r.name, r.types) for r in P.loose_types(args).collect()] == [("n", ["number", "string"])]
    b = spark.createDataFrame([("f", "$.ok", "true", "g")] * 4 + [("f", "$.ok", "false", "h")] * 4 + [("f", "$.same", "x", "g")] * 8, "tool string, path string, value string, next_tool string")
    assert {(r.value, r.next_tool) for r in P.branch_keys(b).collect()} == {("true", "g"), ("false", "h")}
    assert [r.value for r in P.rule_violations(spark.createDataFrame([(1, "f", "mode", "z"), (2, "f", "mode", "a")], "id int, tool string, name string, value string"), P.enumerated_arguments(args)).collect()] == ["z"]
    t = spark.createDataFrame([(i, 0, "q") for i in range(4)] + [(i, 1, "Thanks  !") for i in range(3)], "traj int, pos int, text string")
    assert [(r.text, r.n) for r in P.wrap_ups(t).collect()] == [("thanks !", 3)]
    assert P.round_robin({"a": 2, "b": 1}, 6) == ["a", "b", "a", "a", "b", "a"]
    plan = P.planned_jobs(spark.range(20), "id", 3, ["x", "y", "z"])
    assert {r.id: r.k for r in plan.groupBy("id").agg(F.countDistinct("strategy").alias("k")).collect()} == {i: 3 for i in range(20)}
    pairs = spark.createDataFrame([(s, v) for s in range(4) for v in range(3)], "s int, v int")
    got = P.capped_sweep(pairs, ["s", "v"], {"s": 2, "v": 2})
    assert got.groupBy("s").count().agg(F.max("count")).first()[0] <= 2 and got.groupBy("v").count().agg(F.max("count")).first()[0] <= 2 and got.count() >= 4
    assert P.never_called(spark.createDataFrame([("a", "f"), ("a", "g")], "group string, tool string"), spark.createDataFrame([("a", "f")], "group string, tool string")).first().tool == "g"
    assert {(r.value, r.n, r.mean) for r in P.answer_stats(spark.createDataFrame([("g", "$.n", "1"), ("g", "$.n", "3"), ("g", "$.t", "x")], "grp string, path string, value string"), "grp").collect()} == {("1", 1, None), ("3", 1, None), ("x", 1, None), (None, None, 2.0)}
