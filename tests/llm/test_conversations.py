import json
import random
from datetime import datetime, timedelta

import pytest

from spanloom.llm import conversations as C

SCHEMA = "record_id bigint, rec_type string, session_id string, ts string, client_tz string, is_sidechain boolean, message string, loaded_at timestamp_ntz, key string, block int, words string"
START = datetime(2026, 1, 1)


def row(i, session, minute, kind, content, role=None, side=False, ts=None):
    t = ts if ts is not None else (START + timedelta(minutes=minute)).isoformat() + "Z"
    m = None if content is ... else json.dumps({"role": role or kind, "content": content})
    return (i, kind, session, t, "Europe/Berlin", side, m, START + timedelta(minutes=minute, seconds=5), "k", 1, "w")


def call(i):
    return [{"type": "tool_use", "id": i, "name": "f", "input": {}}]


def result(i):
    return [{"type": "tool_result", "tool_use_id": i, "content": "done"}]


ROWS = [
    row(1, "good", 0, "user", "hello"), row(2, "good", 1, "assistant", call("a")), row(3, "good", 1, "user", result("a")), row(4, "good", 2, "ai", "all done", "ai"), row(5, "good", 2, "ai", "all done", "ai"),
    row(10, "empty", 0, "user", " ​"), row(11, "empty", 1, "assistant", []), row(12, "onlysys", 0, "system", "x"), row(13, "nomsg", 0, "user", ...),
    row(20, "nocall", 0, "user", "q"), row(21, "nocall", 1, "user", result("z")), row(22, "nocall", 2, "assistant", "a"),
    row(30, "noresult", 0, "user", "q"), row(31, "noresult", 1, "assistant", call("y")), row(32, "noresult", 2, "assistant", "a"),
    row(40, "unknown", 0, "user", "q"), row(41, "unknown", 1, "unknown", "boo", "?"), row(42, "unknown", 2, "assistant", "a"),
    row(50, "start", 0, "assistant", "hi"), row(51, "start", 1, "user", "q"), row(52, "start", 2, "assistant", "a"),
    row(60, "noreply", 0, "user", "q"), row(61, "noreply", 1, "assistant", "a"), row(62, "noreply", 2, "user", "and?"), row(63, "noreply", 3, "assistant", ""), row(64, "noreply", 4, "summary", "s"),
    row(70, "image", 0, "user", [{"type": "image", "source": {}}]), row(71, "image", 1, "assistant", "nice"),
    row(80, None, 0, "user", "q"),
]
WANT = {"empty": "empty", "onlysys": "empty", "nomsg": "empty", "nocall": "broken", "noresult": "broken", "unknown": "broken", "start": "broken", "noreply": "no_reply"}


def defects(spark, rows):
    return {r.session_id: r.defect for r in C.found(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_defects(spark):
    assert defects(spark, ROWS) == WANT


def test_conversations_are_ordered_linked_and_whole(spark):
    x = sorted((r for r in C.conversations(spark.createDataFrame(ROWS, SCHEMA)).collect() if r.session_id == "good"), key=lambda r: r.pos)
    assert [(r.record_id, r.speaker, r.parent_id, r.link_kind, r.root_id) for r in x] == [(1, "user", None, "root", 1), (2, "assistant", 1, "reply", 1), (3, "user", 2, "mention", 1), (4, "assistant", 3, "reply", 1)]


def test_side_channel_branches_off_the_main_one(spark):
    rows = [row(1, "s", 0, "user", "compare both files"), row(2, "s", 1, "user", "list the folder", side=True), row(3, "s", 2, "assistant", "comparing both files"), row(4, "s", 3, "assistant", "the folder is empty", side=True)]
    x = {r.record_id: (r.parent_id, r.link_kind) for r in C.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert x == {1: (None, "root"), 2: (1, "branch"), 3: (1, "reply"), 4: (2, "reply")}


def test_a_result_before_its_call_closes_no_circle(spark):
    rows = [row(1, "s", 0, "user", result("a")), row(2, "s", 1, "assistant", call("a")), row(3, "s", 2, "assistant", call("b") + result("b"))]
    assert C.conversations(spark.createDataFrame(rows, SCHEMA)).count() in (0, 3)


@pytest.mark.parametrize("block", [50_000, 7])
def test_hot_session_in_blocks_gives_the_same(spark, monkeypatch, block):
    r = random.Random(5)
    rows = [row(i, "hot", r.randint(0, 90), r.choice(["user", "assistant"]), r.choice(["read the file", "file is read", "and the next"]), side=r.random() < 0.3) for i in range(120)]
    want = C.links(spark.createDataFrame(rows, SCHEMA)).select("record_id", "pos", "parent_id", "link_kind", "score").orderBy("record_id").collect()
    monkeypatch.setattr(C, "BLOCK", block)
    got = C.links(spark.createDataFrame(rows, SCHEMA)).select("record_id", "pos", "parent_id", "link_kind", "score").orderBy("record_id").collect()
    assert got == want


def test_unreadable_times_and_empty_table(spark):
    rows = [row(1, "s", 0, "user", "q", ts="soon"), row(2, "s", 1, "assistant", "a", ts=None)]
    assert defects(spark, rows) == {}
    assert defects(spark, []) == {} and C.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_defects_come_from_the_links(spark, monkeypatch):
    """Without ties every result stands alone; without parents every message is a root, and a plain answer is no reply to anything."""
    rows = [r for r in ROWS if r[2] in ("good", "image")]
    assert defects(spark, rows) == {}
    ties = C.ties
    monkeypatch.setattr(C, "ties", lambda x: ties(x).withColumn("call", C.F.when(C.F.lit(False), C.F.col("call"))))
    assert defects(spark, rows) == {"good": "broken"}
    monkeypatch.setattr(C, "ties", ties)
    plan = C.defects(spark.createDataFrame(rows, SCHEMA), C.links(spark.createDataFrame(rows, SCHEMA)))._jdf.queryExecution().optimizedPlan().toString()
    assert "link_kind" in plan and "parent_id" in plan and "shared" in plan  # the scored links are read


def test_parents_are_messages_that_come_out(spark):
    rows = [row(1, "s", 0, "user", " "), row(2, "s", 1, "user", "hello"), row(3, "s", 2, "assistant", ""), row(4, "s", 3, "assistant", "hi")]
    x = {r.record_id: (r.parent_id, r.root_id, r.text) for r in C.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert x == {2: (None, 2, "hello"), 4: (2, 2, "hi")}
