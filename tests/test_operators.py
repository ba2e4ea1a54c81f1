"""Nulls, ties, repeats, empty tables and extra columns, against small brute-force results."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import corpus as C
from spanloom.operators import evaluation as E
from spanloom.operators import graphs as G
from spanloom.operators import similarity as M
from spanloom.operators.prefix import running, whole_groups

XY = "id int, g string, x double, y int"


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    L = F.lit  # noqa: N806
    assert one(S.words(L("Él dijo: x_1, ¡no!"))) == ["él", "dijo", "x_1", "no"] and one(S.words(L(""))) == []
    w = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (["a", "a", "a", "a"],)], "w array<string>")
    assert [r[0] for r in w.select(S.shingles("w", 2)).collect()] == [["a b", "b c"], ["a"], [], ["a a"]]
    assert [r[0] for r in w.select(S.shingles("w", 2, "none")).collect()] == [["a b", "b c"], [], [], ["a a"]]
    assert one(S.cause(L("job deadbeef01 failed 'at x' after 12 s"))) == "job HEX failed STR after N s"
    assert one(S.truncated(L("abcdef"), 4)) == "abcd… [2 more]" and one(S.truncated(L("abcd"), 4)) == "abcd"
    assert one(S.head_tail(L("abcdefgh"), 2, 2)) == "ab … gh"
    assert one(S.safe_id(L("../a b/c."))) == "a-b-c" or one(S.safe_id(L("../a b/c."))) == "-a-b-c"
    assert [one(S.size_bucket(L(n))) for n in (0, 1, 9, 10, 999, 1000, None)] == ["0", "1", "2-9", "10-99", "100-999", "1000+", None]
    assert one(S.resolved(L('{"a": null, "b": [{"c": 0}]}'), "a")).asDict() == {"present": True, "value": None}
    assert one(S.resolved(L('{"b": [{"c": 0}]}'), "b.0.c")).asDict() == {"present": True, "value": "0"}
    assert one(S.first_present(L('{"b": "", "c": "x"}'), ["a", "b", "c"])) == ""
    assert one(S.unmapped(L('{"a": 1, "b": {"c": 2}}'), ["a"])) == '{"b":{"c":2}}' and one(S.unmapped(L('{"a": 1}'), ["a"])) is None
    assert one(S.without_scaffold(L("<x>1\n2</x> hi <y a='b'>3</y>"), ["x", "y"])) == "hi"
    assert one(S.iso_duration(L("P1DT2H3M4.5S"))) == 93784.5 and one(S.iso_duration(L("P"))) is None and one(S.iso_duration(L("PT"))) is None
    assert [one(S.unix_nanos(L(x))) for x in ("5", "0", "-1", "x", None)] == [5, None, None, None, None]
    assert one(S.answer_matches(L("The answer is: a Red tram!"), L("red tram"))) is False and one(S.answer_matches(L("the Red tram!"), L("red tram"))) is True
    grade = lambda k, a, e, al=None, t=None, r=None: one(S.graded(L(k), L(a).cast("string"), L(e).cast("string"), F.array(*map(L, al)) if al else L(None).cast("array<string>"), L(t).cast("double"), L(r).cast("double")))
    assert [grade("exact", " A  b", "a B"), grade("allowed_set", "X", None, ["x", "y"]), grade("numeric", "$1,000.4", "1000", t=0.5), grade("numeric", "1010", "1000", r=0.02), grade("numeric", "ten", "10"), grade("other", "a", "a"), grade("exact", None, "a")] == [True, True, True, True, False, False, False]
    v = lambda x: F.parse_json(L(x))
    assert [one(S.same_kind_equal(v(a), v(b))) for a, b in (("0", "0"), ("0", "false"), ('""', "null"), ('{"a":1}', '{"a":1}'))] == [True, False, False, True]
    assert one(S.digest_id([L("a"), L(None)])) != one(S.digest_id([L("a"), L("~")]))


def test_corpus_edges(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (2, None, None, 0), (3, "a", 2.0, 1), (3, "b", None, None)], XY)
    assert values(C.group_count(df, "g"), "grp", "n") == values(spark.createDataFrame([("a", 2), (None, 1), ("b", 1)], "grp string, n long"), "grp", "n")
    assert C.unreadable(df, "x > 0").first()["errors"] == 2 and C.query(df, "x > 0", grep='"g":"a"', limit=1).count() == 1
    assert values(C.numbered_ids(df, "id", "g"), "unique_id") == [("1",), ("2",), ("3#1",), ("3",)]
    assert values(C.delta(df.where("g = 'a'").withColumn("n", F.lit(1)), df.withColumn("n", F.lit(1)), "g", "n"), "g", "before", "after", "delta") == [("a", 2, 2, 0), ("b", 0, 1, 1), (None, 0, 1, 1)]
    assert values(C.upsert(df.select("id", "g"), spark.createDataFrame([(3, "z")], "id int, g string"), ["id"]), "id", "g") == [(1, "a"), (2, None), (3, "z")]
    assert values(C.pivoted(spark.createDataFrame([(1, "a", "pass"), (1, "b", "fail"), (1, None, "x")], "k int, c string, v string"), "k", "c", "v").select("k", F.to_json("findings").alias("f")), "f") == [('[{"c":"a","v":"pass"},{"c":"b","v":"fail"}]',)]
    assert values(C.apportioned(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "n string, w double"), "n", "w", 10), "n", "share") == [("a", 4), ("b", 3), ("c", 3)]
    none = df.limit(0)
    for x in (C.stratified(none, ["g"], "id", 5), C.first_last_middle(none, "g", "id"), C.failures_first(none, "y = 0", "id", 5, 2), C.balanced(none, ["g"], [F.col("id")], 3), C.error_groups(none, "g", "id"), C.clashes(none, ["id"], ["g"]), whole_groups(none, "g", F.col("g"), 5), C.duplicate_quarantine(none, "id", ["g"], "x", "g", "y")):
        assert x.count() == 0
    assert [r.id for r in C.stratified(df, ["g"], "id", 3).collect()] == [r.id for r in C.stratified(df.repartition(3), ["g"], "id", 3).collect()]


def test_quarantine(spark):
    rows = [(1, "q1", "a", "g1", "s1"), (1, "q2", "a", "g1", "s1"), (2, "q3", "a", "g1", "s1"), (3, "q3", "b", "g1", "s1"), (4, "q4", "a", "g2", "s1"), (5, "q5", "a", "g2", "s2"), (6, "q6", "a", None, "s1"), (7, "q6", "a", None, "s1")]
    df = spark.createDataFrame(rows, "id int, q string, target string, grp string, split string")
    assert values(C.duplicate_quarantine(df, "id", ["q"], "target", "grp", "split"), "id", "status") == [(1, "duplicate_id"), (1, "duplicate_id"), (2, "conflict"), (3, "conflict"), (4, "group_conflict"), (5, "group_conflict"), (6, "kept"), (7, "repeat")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-3, 3)), max_size=40))
def test_prefix_sums(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a int, b int")
    got = {r.i: r.s for r in running(df, ["a", "i"], {"s": F.col("b")}, 3).collect()}
    total, want = 0, {}
    for i, (_, b) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        want[i] = total
        total += b
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components(spark, links):
    group = {i: i for i in range(15)}
    for _ in range(15):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    want = {n: group[n] for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in G.components(spark.createDataFrame(links, "a int, b int")).collect()} == want


def test_long_chain_of_links(spark):
    assert {r.component for r in G.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a int, b int")).collect()} == {0}


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(40)]
        texts.append(base)
        if i % 3 == 0:
            texts.append([*base[:38], "x", "y"])
        if i % 5 == 0:
            texts.append(base)
        if i % 7 == 0:
            texts.append(base[:20])
    rows = [(i, " ".join(t), "c") for i, t in enumerate(texts)] + [(900, None, ""), (901, "", ""), (902, "", ""), (903, "one two", ""), (904, "One, two!", "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, links string")
    reps, grams = {}, {}
    for i, t, _ in rows:
        if t is not None:
            w = tuple(x for x in "".join(c if c.isalnum() else " " for c in t.lower()).split())
            reps.setdefault(w, i)
            grams[i] = {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set()
    own = {i: reps[tuple(x for x in "".join(c if c.isalnum() else " " for c in t.lower()).split())] for i, t, _ in rows if t is not None}
    heads = sorted(set(own.values()))
    pairs = [(a, b) for a in heads for b in heads if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    cls = {h: h for h in heads}
    for _ in heads:
        for a, b in pairs:
            cls[a] = cls[b] = min(cls[a], cls[b])
    want = {i: (cls[h], sum(x == h for x in own.values()), sum(h in p for p in pairs)) for i, h in own.items()}
    assert {x.doc_id: (x.class_id, x.copies, x.links) for x in M.near_duplicates(df).collect()} == want and pairs
    assert M.near_duplicates(df.limit(0)).count() == 0
    kept = {x.doc_id for x in M.first_of_class(df).collect()}
    assert kept == set(heads) - {b for _, b in pairs}


def test_vectors_with_ties_and_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r.vec_id, round(r.score, 4)) for r in M.nearest_vectors(v, v.where("vec_id = 1"), k=4).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (7, 0.7071), (3, 0.0)]
    assert M.nearest_vectors(v.limit(0), v.where("vec_id = 1")).count() == 0 and M.nearest_vectors(v, v.limit(0)).count() == 0


def test_statistics_edges(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 1), (2, "a", 1.0, 0), (3, "b", None, 1), (4, "b", 0.5, None)], XY)
    r = E.binary_scores(df, "x", "y").first()
    assert (r.n, r.brier) == (2, 1.0) and math.isclose(r.nll, -math.log(1e-15))
    assert E.binary_scores(df.limit(0), "x", "y").first().brier is None
    assert E.reliability_bins(df.limit(0), "x", "y").count() == 10
    assert E.auc(df.where("y = 1"), "x", "y").first().auc is None and E.auc(df.limit(0), "x", "y").first().auc is None
    assert E.bootstrap(df.limit(0), "g", "x").first().mean is None
    q = E.positional(df.limit(0), ["g"], "x", {"p": E.HALF})
    assert q.count() == 0
    x = spark.createDataFrame([(float(v),) for v in (5, 1, 1, 9)], "x double")
    got = E.positional(x, [], "x", {"half": E.HALF, "p99": E.P99, "p90": E.P90_INNER, "near": E.NEAREST_RANK.format(q=0.5)}).first()
    assert (got.half, got.p99, got.p90, got.near) == (5.0, 9.0, 5.0, 1.0)


def test_temperature_of_scaled_logits(spark):
    r = random.Random(1)
    rows = []
    for _ in range(4000):
        z = [r.gauss(0, 1.5) for _ in range(3)]
        p = [math.exp(v) for v in z]
        rows.append(([v * 2.5 for v in z], r.choices(range(3), p)[0]))
    t = E.fit_temperature(spark.createDataFrame(rows, "logits array<double>, gold int"))
    assert abs(t - 2.5) < 0.25
    assert E.fit_temperature(spark.createDataFrame([], "logits array<double>, gold int")) is None


@pytest.mark.parametrize("parts", [1, 5])
def test_same_for_every_partitioning(spark, parts):
    df = spark.createDataFrame([(i, "ab"[i % 2], i / 7, i % 3 == 0 and 1 or 0) for i in range(50)], XY).repartition(parts)
    a = [r.id for r in C.top_by_hash(df, ["g"], "id", 5).orderBy("g", "rank").collect()]
    assert a == [r.id for r in C.top_by_hash(df.coalesce(1), ["g"], "id", 5).orderBy("g", "rank").collect()]
    b = E.bootstrap(df, "g", "x").first()
    assert b.low <= b.mean <= b.high
