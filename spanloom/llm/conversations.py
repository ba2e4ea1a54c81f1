"""Conversations rebuilt from message rows.

Channels that interleave in a session are disentangled: for each message all earlier ones of the
session are its candidate parents, scored by time, mention and lexical overlap; the likeliest becomes
the parent, and the links form trees. Only what can't win is left out: without a shared word the last
message of its channel and speaker scores best of these, and of those with shared words the ones whose
time costs more than a full overlap gains. Tool ids are tied call by call. A session's defect, if any,
is read off the links: results and calls without their tie, the speaker of the first root, and whether
the last user-side message has an assistant's message linked under it; only where it has none, an exact
look at the order of turns follows.

Rows are first reduced to distinct messages with content, then ordered by instant; at equal instants a user's text
comes first, then the assistant, then results, then the smaller record_id. Times that can't be read
count as the time of loading. No window ever spans an unbounded group: sessions of more than BLOCK
messages are cut into blocks by quantiles of their times, and what a block needs of those before it is
carried by one summary row per block; shared words are looked up in the blocks within reach only.

Rows without session_id belong to no conversation. Rows of type system or summary don't count. null
or unreadable messages have no content. Empty tables give no rows. Texts stay out of every shuffle but the
last: what is linked are ids, times, flags and hashes of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.words import plain
from spanloom.operators.instants import with_instant
from spanloom.session import cut

BLOCK = 50_000
# How speakers are written.
USER, ASSISTANT = ("user", "human", "tool", "function"), ("assistant", "ai", "model", "bot", "gpt")


def messages(log: DataFrame) -> DataFrame:
    """One row per log row that counts, with what its message holds."""
    v = F.try_parse_json("message")
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    x = log.where("session_id is not null").withColumn("_v", v).withColumn("_blocks", get("$.content", "array<struct<type: string, text: string, id: string, tool_use_id: string, name: string>>"))
    zones = x.groupBy("session_id").agg(F.max("client_tz").alias("_tz"))
    x = x.join(zones, "session_id").withColumn("_tz", F.coalesce("client_tz", "_tz"))
    x = with_instant(x, "ts", "_tz", "at", settle=True)
    role, kind = F.lower(F.trim(get("$.role"))), F.lower(F.trim("rec_type"))
    of = lambda c: F.when(c.isin(*USER), "user").when(c.isin(*ASSISTANT), "assistant")
    ids = lambda t, key: F.array_distinct(F.filter(F.transform(F.filter("_blocks", lambda b: b["type"] == t), lambda b: F.coalesce(b[key], F.lit(""))), lambda i: F.lit(True)))
    none = F.array().cast("array<string>")
    x = x.select(
        "session_id", "record_id", F.coalesce("at", F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0)).alias("at"),
        (~F.coalesce(kind, F.lit("")).isin("system", "summary")).alias("counts"), F.coalesce(of(role), of(kind)).alias("speaker"), F.coalesce("is_sidechain", F.lit(False)).alias("side"),
        _text(F.col("_v")).alias("text"), F.coalesce(ids("tool_use", "id"), none).alias("calls"), F.coalesce(ids("tool_result", "tool_use_id"), none).alias("results"),
        F.coalesce(F.exists("_blocks", lambda b: b["type"] == "image"), F.lit(False)).alias("image"),
        F.md5(F.regexp_replace(F.coalesce("message", F.lit("")), r"\s+", "")).alias("digest"),
    )
    said = ~F.regexp_replace("text", r"[\s​‌‍⁠﻿ ]+", "").eqNullSafe("")
    words = F.array_distinct(F.transform(F.filter(F.split(plain(F.col("text")), " "), lambda w: w != ""), lambda w: F.xxhash64(w)))
    return x.withColumn("content", said | F.col("image") | (F.size("calls") > 0) | (F.size("results") > 0)).withColumn("words", words)


def texts(log: DataFrame) -> DataFrame:
    """(record_id, text) of each row."""
    return log.select("record_id", _text(F.try_parse_json("message")).alias("text"))


def _text(v: Column) -> Column:
    """A message's text, or the texts of its blocks, a line each."""
    blocks = F.try_variant_get(v, "$.content", "array<struct<type: string, text: string>>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return F.coalesce(F.when(blocks.isNull(), F.try_variant_get(v, "$.content", "string")).otherwise(said), F.lit(""))


def distinct_messages(m: DataFrame) -> DataFrame:
    """Duplicates (same session, time and message) once, as their smallest record_id."""
    cols = [c for c in m.columns if c not in ("session_id", "at", "digest", "record_id", "speaker", "counts")]
    x = m.groupBy("session_id", "at", "digest", "speaker", "counts").agg(F.min(F.struct("record_id", *cols)).alias("m")).select("session_id", "at", "speaker", "counts", "m.*")
    rank = F.when(F.size("results") > 0, 2).when(F.col("speaker") == "assistant", 1).otherwise(0)
    return x.withColumn("key", F.struct("at", rank.alias("rank"), "record_id"))


def with_blocks(x: DataFrame) -> DataFrame:
    """block: 0, or for large sessions the place of the row among quantiles of the session's times, cuts."""
    large = x.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(f"n > {BLOCK}")
    hot = x.select("session_id", "at").join(large, "session_id").groupBy("session_id").agg(F.first("n").alias("n"), F.percentile_approx("at", F.array(*[F.lit(i / 1000) for i in range(1, 1000)]), 10_000).alias("q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(1000.0) * BLOCK / F.col("n"))).cast("int")
    cuts = F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.lit(999)), lambda i: i % step == 0), lambda i: F.get("q", i - 1)))
    hot = cut(hot.select("session_id", cuts.alias("cuts")), "blocks")  # few rows or none
    return x.join(hot, "session_id", "left").withColumn("block", _block_at(F.col("at")))


def _block_at(at: Column) -> Column:
    return F.coalesce(F.size(F.filter("cuts", lambda c: c <= at)), F.lit(0))


# Weights of the link score: a mention settles it, the rest is ordered by channel, turn taking, words, time.
MENTION, CHANNEL, TURN, OVERLAP, DELAY = 10.0, 2.0, 1.0, 1.5, 0.25
CLASSES = {f"l_{'side' if side else 'main'}_{speaker}": (side, speaker) for side in (False, True) for speaker in ("user", "assistant", None)}


def _standing(side: Column, speaker: Column, own_side: Column, own_speaker: Column) -> Column:
    return F.lit(CHANNEL) * (side == own_side).cast("int") + F.lit(TURN) * (~speaker.eqNullSafe(own_speaker)).cast("int")


def _delay(at: Column, own_at: Column) -> Column:
    return F.lit(DELAY) * F.log1p(F.greatest(F.lit(0.0), (own_at - at) / 1e6))


def _option(score: Column, parent_id: Column, reply: Column) -> Column:
    """reply: to a known speaker on the same channel; all else is a branch."""
    return F.struct(score.alias("score"), parent_id.alias("parent_id"), F.when(reply, "reply").otherwise("branch").alias("link_kind"))


def candidates(x: DataFrame) -> DataFrame:
    """Each message with its place, and recent: the best link to an earlier message if shared words counted for nothing.

    Of messages of one channel and speaker that's the last, so six are compared.
    """
    own = ["session_id", "block"]
    order = W.partitionBy(*own).orderBy("key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    speaker = lambda v: F.lit(v).cast("string")
    of = {k: F.when((F.col("side") == F.lit(side)) & F.col("speaker").eqNullSafe(speaker(v)), F.struct("at", "record_id")) for k, (side, v) in CLASSES.items()}
    y = x.withColumns({k: F.max(v).over(before) for k, v in of.items()} | {"n_before": F.row_number().over(order)})
    # what earlier blocks leave, one row per block; only sessions with several blocks have any
    ends = x.where("block > 0").select("session_id").distinct()
    sums = x.join(ends, "session_id", "left_semi").groupBy(*own).agg(*[F.max(v).alias(k) for k, v in of.items()], F.count(F.lit(1)).alias("n"))
    prior = W.partitionBy("session_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*own, *[F.max(k).over(prior).alias(f"c_{k}") for k in of], F.sum("n").over(prior).alias("c_n"))
    y = y.join(sums, own, "left").withColumns({k: F.coalesce(k, f"c_{k}") for k in of})
    lasts = [
        F.when(F.col(k).isNotNull(), _option(_standing(F.lit(side), speaker(v), F.col("side"), F.col("speaker")) - _delay(F.col(k)["at"], F.col("at")), F.col(k)["record_id"], (F.col("side") == F.lit(side)) & F.lit(v is not None)))
        for k, (side, v) in CLASSES.items()
    ]
    return y.select(*x.columns, F.array_max(F.array_compact(F.array(*lasts))).alias("recent"), (F.col("n_before") + F.coalesce("c_n", F.lit(0)) - 1).cast("int").alias("pos"))


def alike(x: DataFrame) -> DataFrame:
    """(session_id, record_id, shared): the best link to an earlier message with a shared word, of those that can be better than recent.

    x: messages with recent and mention. A mention beats every other link, so messages with one aren't looked at.
    """
    # beyond this many seconds a whole overlap on the best standing can't make up for the time; a little more for rounding
    reach = F.least(F.lit(1e12), F.exp((F.lit(CHANNEL + TURN + OVERLAP) - F.col("recent.score")) / DELAY) * 1.000001 + 1)
    least = _block_at(F.col("at") - (reach * 1e6).cast("bigint"))
    new = x.where("recent is not null and mention is null").withColumn("_w", F.explode("words"))
    new = new.select("session_id", "record_id", F.explode(F.sequence(least, "block")).alias("block"), "_w", "key", "at", "speaker", "side", F.size("words").alias("_n"), F.col("recent.score").alias("_least"))
    old = x.select("session_id", F.col("record_id").alias("parent_id"), "block", F.explode("words").alias("_w"), F.col("key").alias("p_key"), F.col("at").alias("p_at"), F.col("speaker").alias("p_speaker"), F.col("side").alias("p_side"), F.size("words").alias("p_n"))
    standing, delay = _standing(F.col("p_side"), F.col("p_speaker"), F.col("side"), F.col("speaker")), _delay(F.col("p_at"), F.col("at"))
    met = new.join(old, ["session_id", "block", "_w"]).where((F.col("p_key") < F.col("key")) & (standing + F.lit(OVERLAP) - delay >= F.col("_least")))
    met = met.select("session_id", "record_id", "parent_id", standing.alias("standing"), delay.alias("delay"), F.least("_n", "p_n").alias("n"), ((F.col("p_side") == F.col("side")) & F.col("p_speaker").isNotNull()).alias("reply"))
    both = met.groupBy("session_id", "record_id", "parent_id").agg(F.count(F.lit(1)).alias("common"), *[F.first(c).alias(c) for c in ("standing", "delay", "n", "reply")])
    score = F.col("standing") + F.lit(OVERLAP) * (F.col("common") / F.col("n")) - F.col("delay")
    return both.groupBy("session_id", "record_id").agg(F.max(_option(score, F.col("parent_id"), F.col("reply"))).alias("shared"))


def ties(x: DataFrame) -> DataFrame:
    """(session_id, tool_id, call, result): each tool id with the first message that calls it and the first that has its result, null where there is none."""
    calls = x.select("session_id", F.explode("calls").alias("tool_id"), "key").groupBy("session_id", "tool_id").agg(F.min("key").alias("call"))
    results = x.select("session_id", F.explode("results").alias("tool_id"), "record_id").groupBy("session_id", "tool_id").agg(F.min("record_id").alias("result"))
    return calls.join(results, ["session_id", "tool_id"], "full")


def matched(log: DataFrame) -> DataFrame:
    """Distinct messages with content, with block, cuts, caller (the first call its results name), unresolved and unanswered.

    unresolved counts results tied to no call of the session, unanswered calls tied to no result.
    """
    x = with_blocks(cut(distinct_messages(messages(log).where("counts").drop("text")).where("content"), "messages"))
    tied = ties(x)
    answered = x.select("session_id", "record_id", F.explode("results").alias("tool_id")).join(tied, ["session_id", "tool_id"]).groupBy("session_id", "record_id").agg(F.sum(F.col("call").isNull().cast("int")).alias("unresolved"), F.min("call").alias("caller"))
    open_calls = tied.where("call is not null and result is null").groupBy("session_id", F.col("call.record_id").alias("record_id")).agg(F.count(F.lit(1)).cast("int").alias("unanswered"))
    x = x.join(answered, ["session_id", "record_id"], "left").join(open_calls, ["session_id", "record_id"], "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("unresolved", "unanswered")})


def links(log: DataFrame) -> DataFrame:
    """Distinct messages with content, each with its likeliest parent.

    (session_id, pos, record_id, at, key, speaker, side, calls, results, parent_id, link_kind, score, unresolved,
    unanswered), the last two as in matched(). Of equal scores the larger record_id is taken.
    """
    # a parent always comes before its child, so links can't close a circle
    mention = F.when(F.col("caller") < F.col("key"), F.struct(F.lit(MENTION).alias("score"), F.col("caller.record_id").alias("parent_id"), F.lit("mention").alias("link_kind")))
    y = cut(candidates(matched(log)).withColumn("mention", mention), "recent")  # read three times
    best = F.array_max(F.array_compact(F.array("mention", "recent", "shared")))
    return y.join(alike(y), ["session_id", "record_id"], "left").withColumn("best", best).select(
        "session_id", "pos", "record_id", "at", "key", "speaker", "side", "calls", "results", "best.parent_id", F.coalesce("best.link_kind", F.lit("root")).alias("link_kind"), "best.score",
        "unresolved", "unanswered",
    )


def defects(log: DataFrame, linked: DataFrame) -> DataFrame:
    """(session_id, defect): the first that fits of empty, broken, no_reply, read off the links. One combinable aggregate per session."""
    told = linked.where("speaker = 'assistant' and parent_id is not null").select("session_id", F.col("parent_id").alias("record_id")).distinct().withColumn("replied", F.lit(True))
    user_side = (F.col("speaker") == "user") | (F.size("results") > 0)
    per = linked.join(told, ["session_id", "record_id"], "left").groupBy("session_id").agg(
        F.sum(F.col("unresolved") + F.col("unanswered") + F.col("speaker").isNull().cast("int")).alias("bad"),
        F.min(F.when(F.col("link_kind") == "root", F.struct("key", F.coalesce("speaker", F.lit("?")).alias("speaker")))).alias("root"),
        F.max(F.when(user_side, F.struct("key", F.coalesce("replied", F.lit(False)).alias("replied")))).alias("asked"),
        F.max(F.when(F.col("speaker") == "assistant", F.col("key"))).alias("told"),
    )
    sessions = log.where("session_id is not null").select("session_id").distinct()
    # a message nobody is linked under may still be followed by an answer that was linked elsewhere
    unanswered = ~F.col("asked.replied") & F.coalesce(F.col("told") < F.col("asked.key"), F.lit(True))
    defect = F.when(F.col("root").isNull(), "empty").when((F.col("bad") > 0) | (F.col("root.speaker") != "user"), "broken").when(F.coalesce(unanswered, F.col("told").isNull()), "no_reply")
    return sessions.join(per, "session_id", "left").select("session_id", defect.alias("defect")).where("defect is not null")


def found(log: DataFrame) -> DataFrame:
    return defects(log, cut(links(log), "links"))


def threads(linked: DataFrame) -> DataFrame:
    """(session_id, record_id, root_id): the tree of each message, by pointer doubling over the links.

    A round looks up the distinct messages that are pointed at, and only rows that have not reached their root take
    part in it; those that have are left where they were written.
    """
    start = linked.select("session_id", "record_id", F.coalesce("parent_id", "record_id").alias("root_id"), F.col("parent_id").isNull().alias("done"))
    up = cut(start, "threads")
    whole, moving = up.where("done"), up.where("not done")
    while not moving.isEmpty():
        asked = moving.select("session_id", "root_id").distinct()
        above = whole.unionByName(moving).select("session_id", F.col("record_id").alias("root_id"), F.col("root_id").alias("_next"), F.col("done").alias("_done"))
        above = above.join(asked, ["session_id", "root_id"], "left_semi")
        step = cut(moving.join(above, ["session_id", "root_id"]).select("session_id", "record_id", F.col("_next").alias("root_id"), F.col("_done").alias("done")), "threads")
        whole, moving = whole.unionByName(step.where("done")), step.where("not done")
    return whole.drop("done")


def conversations(log: DataFrame) -> DataFrame:
    """The messages with content of usable sessions, in order, each with speaker, parent and thread."""
    linked = cut(links(log), "links")
    keep = linked.join(defects(log, linked), "session_id", "left_anti").join(threads(linked), ["session_id", "record_id"]).join(texts(log), "record_id")
    return keep.select("session_id", "pos", "record_id", F.col("at").alias("utc_us"), "speaker", "side", "text", "calls", "results", "parent_id", "link_kind", F.round("score", 6).alias("score"), "root_id")
