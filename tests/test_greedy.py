"""Greedy dropping keeps what is similar to no kept document, also on chains and by bucket."""

import random

import pytest

from spanloom.operators import similarity as M

SCHEMA = "doc_id int, text string, bucket string"


def grams(t):
    w = t.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def greedy(rows, bucketed):
    """As the reference's dedup(): one by one, against those kept in the bucket."""
    kept = {}
    for i, t, b in sorted(rows):
        own = kept.setdefault(b if bucketed else 0, {})
        if all(len(grams(t) & g) / len(grams(t) | g) < 0.8 for g in own.values()):
            own[i] = grams(t)
    return {i for own in kept.values() for i in own}


def window(start, size=54):
    return " ".join(f"w{k}" for k in range(start, start + size))


def test_chain_keeps_every_other(spark):
    rows = [(i, window(4 * i), None) for i in range(6)]  # neighbours are similar, others aren't
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in M.greedy_kept(df).collect()} == {0, 2, 4} == greedy(rows, False)
    assert {r.doc_id for r in M.first_of_class(df).collect()} == {0}


@pytest.mark.parametrize("bucketed", [False, True])
def test_as_one_by_one(spark, bucketed):
    r = random.Random(3)
    rows = [(i, window(r.choice([0, 200]) + r.randint(0, 30)), r.choice(["a", "b", None])) for i in range(60)] + [(100, window(0), "c"), (101, window(0), "c"), (102, "", "c"), (103, "one two", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id for x in M.greedy_kept(df, bucket="bucket" if bucketed else None).collect()}
    assert got == greedy(rows, bucketed) and len(got) > 5
    assert M.greedy_kept(df.limit(0), bucket="bucket").count() == 0
