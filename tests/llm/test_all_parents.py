"""Every earlier message of a session is a candidate parent."""

import math
import random
import re

import pytest

from spanloom.llm import conversations as C
from tests.llm.test_conversations import SCHEMA, row


def linked(spark, rows):
    return {r.record_id: r for r in C.links(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_interleaved_channels_are_told_apart(spark):
    rows = [
        row(1, "s", 0, "user", "resize the holiday photos"), row(2, "s", 1, "user", "translate this german letter"),
        row(3, "s", 2, "assistant", "resize of the holiday photos is under way"), row(4, "s", 3, "assistant", "to translate the german letter takes a minute"),
        row(5, "s", 4, "assistant", "the holiday photos are small now"),
    ]
    x = linked(spark, rows)
    assert [x[i].parent_id for i in (3, 4, 5)] == [1, 2, 1]


def test_side_agents_are_told_apart(spark):
    rows = [row(1, "s", 0, "user", "start both agents")] + [row(i, "s", i, k, t, side=True) for i, k, t in [(2, "user", "count red apples"), (3, "user", "sort green pears"), (4, "assistant", "red apples count is nine"), (5, "assistant", "green pears sort done")]]
    x = linked(spark, rows)
    assert [x[i].parent_id for i in (4, 5)] == [2, 3] and x[4].link_kind == "reply"


@pytest.mark.parametrize("block", [50_000, 9])
def test_links_are_the_best_of_all_earlier_messages(spark, monkeypatch, block):
    r = random.Random(8)
    vocabulary = "red green blue apples pears plums count sort wash now later never".split()
    rows = [row(i, f"s{i % 2}", 0 if i == 1 else round(math.exp(r.uniform(0, 9)), 2), r.choice(["user", "assistant", "odd"]), " ".join(r.sample(vocabulary, r.randint(0, 4))) + "!" * i, side=r.random() < 0.4) for i in range(140)]
    monkeypatch.setattr(C, "BLOCK", block)
    got = linked(spark, rows)
    text = {r.record_id: set(re.findall(r"\w+", r.text)) for r in C.texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    old = 0
    for i, g in got.items():
        earlier = [p for p in got.values() if p.session_id == g.session_id and p.key < g.key]
        score = lambda p: 2 * (p.side == g.side) + (p.speaker != g.speaker) + 1.5 * len(text[i] & text[p.record_id]) / max(1, min(len(text[i]), len(text[p.record_id]))) - 0.25 * math.log1p((g.at - p.at) / 1e6)  # noqa: B023, E731
        if not earlier:
            assert g.link_kind == "root" and g.parent_id is None
            continue
        best = max(map(score, earlier))
        assert math.isclose(g.score, best, abs_tol=1e-9) and math.isclose(score(got[g.parent_id]), best, abs_tol=1e-9)
        old += sum(p.key > got[g.parent_id].key and p.side == g.side for p in earlier) > 3
    assert len(got) == len(rows) and old > 5
