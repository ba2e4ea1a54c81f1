import json
import math

import pytest

from spanloom.operators import reports as R
from spanloom.operators import trees as T
from spanloom.operators import workflow as X
from spanloom.operators.profiles import capped_sweep
from spanloom.operators.prefix import ranked
from spanloom.sources import contracts as K

TARGETS = [("a", "x", 0, 1.0), ("a", "y", 1, 0.0), ("b", "x", 0, 0.0), ("b", "y", 1, 1.0), ("c", "x", 0, 0.5), ("c", "y", 1, 0.5), ("d", "x", 0, 1.0), ("d", "y", 1, 0.0)]
PRED = [("a", "x", 0.8), ("a", "y", 0.2), ("b", "x", 0.5), ("b", "y", 0.5), ("c", "x", 0.4), ("c", "y", 0.6)]


def frames(spark):
    return spark.createDataFrame(TARGETS, "id string, option string, pos int, t double"), spark.createDataFrame(PRED, "id string, option string, p double")


def test_column_report(spark):
    t, p = frames(spark)
    lat = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("z", 9.0)], "id string, seconds double")
    passes = spark.createDataFrame([("a", 0, "x", 0, 0.9), ("a", 0, "y", 1, 0.1), ("a", 1, "x", 0, 0.3), ("a", 1, "y", 1, 0.7), ("b", 0, "x", 0, 1.0), ("b", 1, "x", 0, 1.0)], "id string, pass int, option string, pos int, p double")
    r = R.column_report(t, p, lat, passes).first()
    assert (r.rows, r.coverage, r.accuracy, r.tied_targets, r.latency_rows) == (3, 0.75, 0.5, 1, 3)
    assert math.isclose(r.adjusted_accuracy, 1 / 3) and (r.latency_mean, r.latency_p50, r.latency_p95) == (2.0, 2.0, 3.0)
    assert math.isclose(r.nll, (-math.log(0.8) - math.log(0.5) - 0.5 * math.log(0.4) - 0.5 * math.log(0.6)) / 3) and math.isclose(r.brier, (0.08 + 0.5 + 0.02) / 3)
    assert math.isclose(r.ece, 0.35) and r.order_agreement == 0.5 and math.isclose(r.order_shift, 0.3)
    none = R.column_report(t.limit(0), p.limit(0)).first()
    assert none.rows == 0 and none.accuracy is None and none.latency_p50 is None


def test_compared_with_intervals(spark):
    t, p = frames(spark)
    groups = spark.createDataFrame([(i, f"g{k % 2}") for k, i in enumerate("abcd")], "id string, grp string")
    got = {r.metric: r for r in R.compared(t, p, p.where("id = 'a'"), groups).collect()}
    assert set(got) == {"accuracy", "nll", "brier"} and got["accuracy"].estimate == 0.0
    assert all(r.low <= r.estimate <= r.high for r in got.values()) and got["nll"].estimate < 0


def test_costs_roles_and_causes(spark):
    runs = spark.createDataFrame([("v", "a", 0.002, 1.0, None), ("v", "b", None, 1.0, None), ("w", "a", None, 2.0, 0.5), ("w", "b", None, 2.0, 0.5), ("l", "a", None, 3.6, None), ("n", "a", None, None, None)], "column string, id string, usd double, seconds double, bill double")
    assert {r.column: (round(r.usd_per_1k, 6) if r.usd_per_1k is not None else None, r.basis, r.covered) for r in R.cost_per_thousand(runs, 2.0).collect()} == {"v": (2.0, "ledger", 1), "w": (250.0, "bill", 0), "l": (2.0, "time", 0), "n": (None, "unknown", 0)}
    calls = spark.createDataFrame([("judge", True, 0.1, 1.0), ("judge", True, None, 3.0), ("judge", False, 0.2, 99.0), (None, None, None, None)], "role string, ok boolean, cost double, latency_s double")
    assert {tuple(r) for r in R.role_stats(calls).collect()} == {("judge", 3, 1, 0.3, 2.0, 1.0), ("?", 1, 1, 0.0, None, None)}
    gates = spark.createDataFrame([(f"t{i}", "wrong", "fail", f"answer {i}") for i in range(5)] + [("u", "noop", "fail", ""), ("u", "oracle", "pass", ""), ("w", "oracle", "error", "disk full"), ("x", "oracle", "not_run", None)], "task_id string, gate string, state string, why string")
    got = {r.cause: (r.n, r.examples) for r in R.failure_causes(gates).collect()}
    assert got == {"a wrong answer was accepted: answer N": (5, ["t0", "t1", "t2"]), "an empty answer was accepted": (1, ["u"]), "infrastructure, oracle: disk full": (1, ["w"])}


def test_turns_splits_and_coverage(spark, tmp_path):
    m = spark.createDataFrame([("c", i, r) for i, r in enumerate(["user", "assistant", "user", "assistant", "assistant", "assistant"])], "conv string, idx int, role string")
    j = spark.createDataFrame([("c", 1, "justified", "", ["0"]), ("c", 3, "unfounded", "made up", ["system", "3"]), ("c", 4, "justified", None, [])], "conv string, idx int, verdict string, reason string, relies_on array<string>")
    assert {(r.idx, r.issue) for r in R.unjustified_turns(m, j).collect()} == {(3, "unfounded: made up"), (3, "cites what is not before it: 3"), (4, "cites nothing"), (5, "not judged")}
    rows = spark.createDataFrame([("q", s, f"k{i}") for i in range(400) for s in ("train", "test", "validation")], "candidate string, source_split string, key string")
    rules = spark.createDataFrame([("q", "test", "dev|test"), ("q", "none", "x")], "candidate string, source_split string, split string")
    done, unknown = R.carved(rows, rules)
    n = {(r.source_split, r.split): r["count"] for r in done.groupBy("source_split", "split").count().collect()}
    assert 20 <= n["train", "calibration"] <= 60 and 150 <= n["test", "dev"] <= 250 and unknown.count() == 400
    assert [r.split for r in R.held_out_first(done.where("key = 'k1' or key = 'k2'"), "key").collect()][-1] in ("train", "calibration")
    seeds = spark.range(100).withColumnRenamed("id", "seed")
    dev, held = R.held_out(seeds, "seed", 0.2, str(tmp_path / "held"))
    first = {r.seed for r in held.collect()}
    more, again = R.held_out(spark.range(200).withColumnRenamed("id", "seed"), "seed", 0.9, str(tmp_path / "held"))
    assert len(first) == 20 and dev.count() == 80 and {r.seed for r in again.collect()} == first and more.count() == 180
    kept, bad = R.quarantined(seeds, "seed", ["1"])
    assert bad.count() == 11 and kept.count() == 89
    x = spark.createDataFrame([("A ",), ("a",), (None,), ("b",)], "v string")
    assert [tuple(r) for r in R.coverage({"w": (x, x["v"])}, 2).orderBy("rank").collect()] == [("w", "a", 2, 1), ("w", "?", 1, 2)]
    v = spark.createDataFrame([("t", 1, "ok"), ("t", 2, "no"), ("t", 9, "?")], "trace_id string, turn int, verdict string")
    turns = spark.createDataFrame([("t", 1, "s1"), ("t", 2, "s2"), ("t", 2, "s3")], "trace_id string, turn int, state string")
    good, odd = R.decided(v, turns)
    assert [(r.turn, r.state) for r in good.collect()] == [(1, "s1")] and {(r.turn, r.why) for r in odd.collect()} == {(2, "several such turns"), (9, "no such turn")}


def test_ancestors_candidates_and_nearest(spark):
    chain = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(20)] + [("u", "a", "b"), ("u", "b", "a"), ("u", "c", "gone")]
    s = spark.createDataFrame(chain, "trace_id string, span_id string, parent_span_id string")
    got = {(r.span_id, r.anc_id): r.depth for r in X.ancestors(s).where("trace_id = 't'").collect()}
    assert got == {(f"s{i}", f"s{j}"): i - j for i in range(20) for j in range(i)}
    assert {(r.span_id, r.anc_id) for r in X.ancestors(s).where("trace_id = 'u'").collect()} == {("a", "b"), ("b", "a")}
    marked = X.ancestors(s).join(spark.createDataFrame([("t", "s3"), ("t", "s7")], "trace_id string, anc_id string").withColumn("f", X.F.lit(True)), ["trace_id", "anc_id"], "left")
    near = {r.span_id: r.enclosing for r in X.nearest_enclosing(marked, X.F.col("f")).collect()}
    assert near["s4"] == "s3" and near["s9"] == "s7" and "s3" not in near
    tree = [("t", "box", None, "step", True, 0), ("t", "run", "box", "step", False, 1), ("t", "in", "run", "step", False, 2), ("t", "llm", "box", "model", False, 3), ("t", "run2", "box", "none", None, 4)]
    x = spark.createDataFrame(tree, "trace_id string, span_id string, parent_span_id string, role string, container boolean, at int")
    assert [(r.span_id, r["rank"]) for r in T.invocation_candidates(x, ["at"]).orderBy("rank").collect()] == [("run", 1), ("run2", 2)]


def test_greedy_sweep_is_exact(spark):
    import random

    got = capped_sweep(spark.createDataFrame([(1, "s1", "v1"), (2, "s1", "v2"), (3, "s2", "v2")], "n int, s string, v string"), ["n"], {"s": 1, "v": 1})
    assert {r.n for r in got.collect()} == {1, 3}
    r = random.Random(4)
    rows = [(n, f"s{r.randrange(6)}", f"v{r.randrange(6)}") for n in range(80)]
    taken, had = [], {}
    for n, s, v in rows:
        if had.get(s, 0) < 2 and had.get(v, 0) < 3:
            taken.append(n)
            had[s], had[v] = had.get(s, 0) + 1, had.get(v, 0) + 1
    assert sorted(x.n for x in capped_sweep(spark.createDataFrame(rows, "n int, s string, v string"), ["n"], {"s": 2, "v": 3}).collect()) == taken


def test_ranked_and_leaves_go_all_the_way(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"g{i}") for i in range(90)], "i int, g string")
    got = {r.i: (r.at, r.n) for r in ranked(df, "g", ["i"], "at", "n").collect()}
    assert got[0] == (0, 30) and got[3] == (1, 30) and got[1] == (0, 30) and got[88] == (29, 30) and got[5] == (0, 1)
    deep = "x"
    for k in range(12):
        deep = {f"k{k}": deep} if k % 2 else [deep]
    x = X.leaves(spark.createDataFrame([(1, json.dumps({"a": deep, "b": json.dumps({"c": 1})})), (2, "{"), (3, None)], "id int, j string"), ["id"], "j")
    assert {(r.path, r.value) for r in x.collect()} == {("$.a" + "".join(f".k{k}" if k % 2 else "[]" for k in range(11, -1, -1)), "x"), ("$.b.c", "1")}


def test_text_links_of_a_hot_trace(spark):
    body = "the answer that the tool gave is forty two and then some more words"
    calls = spark.createDataFrame([("t", f"c{i}", f"{body} {i}", 10) for i in range(60)], "trace_id string, span_id string, output string, end_ns bigint")
    targets = spark.createDataFrame([("t", f"x{i}", f"so: {body} {i}, as said", 20) for i in range(60)] + [("t", "early", f"so: {body} 1, as said", 5)], "trace_id string, span_id string, text string, start_ns bigint")
    got = {(r.call_span_id, r.target_span_id) for r in X.text_links(calls, targets).collect()}
    assert got == {(f"c{i}", f"x{j}") for i in range(60) for j in range(60) if f"{body} {i}" in f"so: {body} {j}, as said"}


def test_contracts_and_archive(spark):
    good = {"schema_version": "2", "ended_at": "2026-01-01T01:00:00Z", "assignment_id": "x", "session_revision_id": "r", "session_id": "s", "agent_id": "a", "environment": "e", "started_at": "2026-01-01T00:00:00Z", "event_count": 1, "events": [{}]}
    cases = [(good, []), (good | {"event_count": 2}, ["event_count is not the number of events"]), (good | {"schema_version": 2}, ["schema_version is not one of 1, 2"]), ({**good, "agent_id": 7}, ["agent_id must be a string"]), ({k: v for k, v in good.items() if k not in ("events", "event_count")} | {"schema_version": "1"}, [])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(9, "{")], "i int, r string")
    got = {r.i: r.p for r in df.select("i", K.envelope_problems(df["r"]).alias("p")).collect()}
    assert [got[i] for i in range(5)] == [w for _, w in cases] and got[9][0] == "not readable"
    e = [('{"id": 1, "ts": "2026-01-01T00:00:00Z", "event_type": "x"}', "1", []), ('{"id": 1, "ts": "2026-01-01T00:00:00Z", "event_type": "x"}', "2", ["id must be a string", "payload must be an object"]), ('{"id": "7", "ts": "soon", "event_type": 3, "payload": null}', "1", ["ts must be a time", "event_type must be a string", "payload must be an object (it is null)"]), ("[]", "1", ["not an event object"]), (None, "1", ["not an event object"])]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(e)], "i int, e string, v string")
    assert [r.p for r in df.select("i", K.event_problems(df["e"], df["v"]).alias("p")).orderBy("i").collect()] == [w for *_, w in e]
    rec = spark.createDataFrame([("f", 0, "mail bob@corp.de"), ("f", 1, "plain"), ("g", 0, None)], "file string, pos bigint, record string")
    source, manifest = K.archived(rec)
    assert {(r.file, r.pos): r.record for r in source.collect()} == {("f", 0): "mail [email]", ("f", 1): "plain", ("g", 0): None}
    m = {r.file: r for r in manifest.collect()}
    assert (m["f"].records, m["f"].redactions) == (2, 1) and m["f"].original != m["f"].redacted and m["g"].original == m["g"].redacted
    again = K.archived(rec.repartition(3))[1].where("file = 'f'").first()
    assert again.original == m["f"].original


@pytest.mark.parametrize("text, found", [("say Forty   two apples now", {1}), ("x42y and 77", {2, 3}), ("", set()), (None, set())])
def test_holding(spark, text, found):
    from spanloom.operators.similarity import holding

    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "Forty two\napples"), (2, "42"), (3, "and 77"), (4, " "), (5, None)], "item_id int, answer string")
    assert {r.item_id for r in holding(docs, "doc_id", "text", items, "item_id", "answer").collect()} == found
