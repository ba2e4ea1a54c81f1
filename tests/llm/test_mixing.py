import random

import pytest

from spanloom.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, tokens int, h int"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def corpus(n=3000, seed=4):
    r = random.Random(seed)
    return [(i, "word " * r.randint(1, 60), r.choice(["big", "BIG", "big ", "mid-size", "mid_size", "tiny"] if i % 10 else ["tiny"]), 1, 1) for i in range(n)] + [(None, "x", "big", 1, 1), (-1, None, "big", 1, 1), (-2, "x", None, 1, 1), (-3, "x", " ", 1, 1), (-4, "", "tiny", 1, 1)]


def test_shares_are_met_within_repeats(spark):
    docs = corpus()
    targets = [("m", "big", 0.5, 1), ("m", "mid_size", 0.3, 2), ("m", "tiny", 0.2, 3), ("small", "big", 0.9, 1), ("small", "tiny", 0.1, 1)]
    drawn, report = M.draw(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), total_tokens={"small": 5000})
    for r in report.collect():
        assert abs(r.actual_share - r.target_share) < 0.01 and r.repeats <= r.max_repeats
        assert r.mix_name != "small" or abs(r.tokens_drawn - 5000 * r.target_share) <= 61
    rows = drawn.collect()
    assert all(r.copies >= 1 for r in rows) and len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    # smaller budgets of a source are contained in larger ones
    big = {m: {r.doc_id for r in rows if r.mix_name == m and r.source == "big"} for m in ("m", "small")}
    assert big["small"] < big["m"]


def test_thresholds_against_sorting(spark):
    docs = spark.createDataFrame([(i, "s", 1 + i % 7, (i * 2654435761) % (1 << 60)) for i in range(2000)], "doc_id bigint, source string, tokens bigint, h bigint")
    total = sum(1 + i % 7 for i in range(2000))
    for budget in (0, 1, 57, total // 3, total - 1, total, total + 5):
        below = M.threshold(docs, {("m", "s"): ("s", budget)})[("m", "s")]
        got = docs.where(f"h < {below}").groupBy().sum("tokens").first()[0] or 0
        assert abs(got - min(budget, total)) <= 4


def test_tokenizer_is_the_public_one():
    e = M._encoding(M.TOKENIZER)
    assert e.encode_ordinary("Hello world") == [15496, 995]


def test_missing_source_and_empty_tables(spark):
    docs, targets = spark.createDataFrame(corpus(50), DOCS), spark.createDataFrame([("m", "big", 0.5, 1), ("m", "nowhere", 0.5, 1)], TARGETS)
    drawn, report = M.draw(docs, targets)
    assert drawn.count() == 0 and {(r.source, r.actual_share) for r in report.collect()} == {("big", 0.0), ("nowhere", 0.0)}
    drawn, report = M.draw(spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS))
    assert drawn.count() == 0 and report.count() == 0


@pytest.mark.parametrize("name, want", [("Agent-Sessions ", "agent_sessions"), (" ", None), (None, None)])
def test_source_names(spark, name, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(name,)], "s string").select(M.source_name(F.col("s"))).first()[0] == want
