"""Signatures and evidence are of every event of a user, not of the first or last few."""

import pytest

from spanloom.operators import evaluation as E
from spanloom.plans import catalog
from tests.conftest import SMALL
from tests.oracle import connect, same

SCHEMA = "user_id int, ts int, event_type string"
SIGNATURES = """with s as (select user_id, string_agg(event_type, '>' order by ts, event_id) sig from events group by 1), g as (select sig, count(*) n from s group by 1)
    select count(*) kinds, round(-sum(n / t * log2(n / t)), 6) bits from g cross join (select sum(n) t from g)"""


def test_signature_entropy_is_of_whole_lists(spark):
    same(catalog.QUERIES["signature_entropy"](spark, SMALL), SIGNATURES, connect(SMALL))


@pytest.mark.parametrize("block", [256, 3, 1])
def test_signatures_differ_from_the_fourth_event_on(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    lists = {1: "abcd", 2: "abce", 3: "abcd", 4: "abc", 5: "abcdabcdx", 6: "abcdabcdy", 7: ""}
    rows = [(u, k, a) for u, s in lists.items() for k, a in enumerate(s)] + [(7, 0, None), (3, 9, None), (None, 0, "a")]
    sig = {r.user_id: r.sig for r in E.signatures(spark.createDataFrame(rows, SCHEMA), "user_id", ["ts"], "event_type").collect()}
    assert sig[1] == sig[3] and len(set(sig.values())) == 7 and len(sig) == 8


CELLS = """select event_type action, evidence, count(*) cells from
    (select event_type, coalesce(string_agg(event_type, '>') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), '') evidence from events) group by 1, 2"""


def test_decision_cells_are_of_the_whole_evidence(spark):
    same(catalog.QUERIES["decision_cells"](spark, SMALL), CELLS, connect(SMALL))


@pytest.mark.parametrize("block", [256, 3, 1])
def test_evidence_tells_whole_histories_apart(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    lists = {1: "abcdefg", 2: "abcdefh", 3: "xbcdefg", None: "abxdefg"}
    rows = [(u, k, a) for u, s in lists.items() for k, a in enumerate(s)] + [(1, 9, None), (1, 10, "z")]
    got = E.histories(spark.createDataFrame(rows, SCHEMA), "user_id", ["ts"], "event_type").collect()
    name = {}
    for r in got:
        past = [a for u, k, a in rows if u == r.user_id and k < r.ts and a]
        assert name.setdefault(tuple(past), r.evidence) == r.evidence
    assert len(got) == len(rows) and len(set(name.values())) == len(name)
    if block == 256:
        assert all(v == ">".join(k) for k, v in name.items())
