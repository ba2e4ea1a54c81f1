from pyspark.sql import functions as F

from spanloom.functions.scalars import words
from spanloom.operators import curation as Q


def got(df, *cols):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in cols)) for r in df.collect()}


def test_eligibility_and_overrides(spark):
    items = spark.createDataFrame([(1, "a", ["f"]), (2, "b", ["f", "g"]), (3, None, [])], "item_id int, label string, called array<string>")
    v = spark.createDataFrame([("any", [], []), ("b_g", ["b"], ["g"]), ("f", [], ["f"])], "variation string, applies_to array<string>, needs array<string>")
    assert got(Q.applicable(items, v), "item_id", "variation") == {(1, "any"), (2, "any"), (3, "any"), (2, "b_g"), (1, "f"), (2, "f")}
    assert [r[0] for r in items.select(Q.reasons({"labelled": F.col("label").isNotNull(), "is_a": F.col("label") == "a"})).collect()] == [[], ["is_a"], ["labelled", "is_a"]]
    s = spark.createDataFrame([("x", "none"), ("y", "step")], "name string, role string")
    new, lost = Q.overridden(s, spark.createDataFrame([("x", "tool"), ("z", "model")], "name string, role string"))
    assert got(new, "name", "role") == {("x", "tool"), ("y", "step")} and got(lost, "name") == {("z",)}
    assert got(Q.siblings(spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, "h"), (5, "i"), (6, "i")], "id int, g string"), "id", "g"), "id", "sibling") == {(1, 2), (1, 3), (2, 3), (2, 1), (3, 1), (3, 2), (5, 6), (6, 5)}


def test_texts(spark):
    r = spark.createDataFrame([("c", 1, "[result:1] a"), ("c", 5, "[result:3] b"), ("c", 7, "none"), ("c", 8, None)], "conv string, idx int, content string")
    assert got(Q.index_breaks(r, ["conv"]), "idx", "said", "is") == {(5, 3, 2), (7, None, 3), (8, None, 4)}
    a = spark.createDataFrame([(1, "one two three four"), (2, "x y z")], "row_id int, text string")
    assert got(Q.copied_rows(a, spark.createDataFrame([("zero ONE two, three",)], "text string"), "text", 3), "row_id", "gram") == {(1, "one two three")}
    w = spark.createDataFrame([("a b c d", "d c b"), ("", "x")], "q string, s string").select(words("q").alias("q"), words("s").alias("s"))
    assert [r[0] for r in w.select(Q.words_covered(F.col("q"), F.col("s"))).collect()] == [0.75, 0.0]
    made = spark.createDataFrame([(1, "s", ["f", "g", "h"]), (2, "s", ["g", "f"]), (3, "s", ["f"])], "item_id int, seed_id string, tools array<string>")
    assert got(Q.fidelity(made, spark.createDataFrame([("s", ["f", "g"])], "seed_id string, tools array<string>")), "item_id", "same_tools", "order_kept", "extra_tools") == {(1, True, True, ("h",)), (2, True, False, ()), (3, False, True, ())}
    m = spark.createDataFrame([("c", 1, "tool", "x" * 9, None), ("c", 0, "user", "hi", None), ("c", 2, None, None, "[f]")], "conv string, idx int, role string, content string, calls string")
    assert Q.rendered(m, "conv", most=4).first().text == "[0] user: hi\n[1] tool: xxxx…\n[2] ?:  -> [f]"


def test_packages_and_gates(spark):
    f = spark.createDataFrame([("t", "task.toml"), ("t", "env/a"), ("t", "env/a"), ("t", "../x"), ("u", "odd")], "task_id string, path string")
    assert got(Q.structure(f, [r"task\.toml"], ["env/.*"]), "task_id", "problem", "path") == {("t", "repeated_path", "env/a"), ("t", "unsafe_path", "../x"), ("t", "unexpected_path", "../x"), ("u", "unexpected_path", "odd"), ("u", "missing_path", r"task\.toml")}
    o = spark.createDataFrame([("t", "oracle", "1", 0, "done", 1.0), ("t", "noop", "1", 0, "done", 0.5), ("t", "wrong", "1", 0, "crashed", None), ("t", "stability", "1", 0, "done", 1.0), ("t", "stability", "1", 1, "done", 0.0), ("u", "oracle", "1", 0, "done", None)], "task_id string, gate string, item string, trial int, state string, reward double")
    assert got(Q.gate_verdicts(o), "task_id", "gate", "verdict") == {("t", "oracle", "pass"), ("t", "noop", "fail"), ("t", "wrong", "error"), ("t", "stability", "fail"), ("u", "oracle", "fail")}
    leaks = spark.createDataFrame([("t", " Yes "), ("t", "7719"), ("u", "yes")], "task_id string, value string")
    assert got(Q.exempted(leaks, spark.createDataFrame([("t", "yes")], "task_id string, label string")), "task_id", "value") == {("t", "7719"), ("u", "yes")}
    led = spark.createDataFrame([("a", 1, 5, False), ("a", 1, 7, True), ("b", 1, 1, False), ("z", 9, 1, False)], "trace_id string, turn int, tokens int, failed boolean")
    dec = spark.createDataFrame([("d1", "a", 1), ("d2", "b", 1), ("d3", "b", 1)], "decision_id string, trace_id string, turn int")
    sums, refused = Q.attributed(led, dec)
    assert got(sums, "decision_id", "calls", "failures", "tokens") == {("d1", 2, 1, 12)} and got(refused, "trace_id", "n") == {("b", 2)}
