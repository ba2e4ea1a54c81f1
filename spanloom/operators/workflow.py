"""Requests, tasks and evidence in traces.

Evidence links tie a tool call to the records its result reappears in. Text is only compared within a
trace: whole leaves by equi-join on a hash, longer texts that may stand inside others by an equi-join on
the hash of their first LEAST characters, verified by containment. So a hot trace costs what its records
share, not their pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import collapse
from spanloom.session import cut

LEAST = 40  # characters; shorter texts have to be a whole leaf


def chosen_invocation(candidates: DataFrame) -> DataFrame:
    """(trace_id, span_id, task, how) from candidates (trace_id, span_id, task): the sole one, the only one with a
    task, the first of several that agree; none, with how 'conflict' or 'no_task', otherwise.
    """
    said = F.when(F.trim("task") != "", F.trim("task"))
    g = candidates.withColumn("_t", said).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count("_t").alias("k"), F.countDistinct("_t").alias("d"), F.min("span_id").alias("one"), F.min_by("span_id", F.when(F.col("_t").isNotNull(), F.col("span_id"))).alias("first"), F.min("_t").alias("_t"))
    how = F.when(F.col("n") == 1, "sole").when(F.col("k") == 1, "only_resolving").when((F.col("k") > 1) & (F.col("d") == 1), "agreement").when(F.col("d") > 1, "conflict").otherwise("no_task")
    ok = how.isin("sole", "only_resolving", "agreement")
    return g.select("trace_id", F.when(how == "sole", F.col("one")).when(ok, F.col("first")).alias("span_id"), F.when(ok, F.col("_t")).alias("task"), how.alias("how"))


def resolved_task(declared: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """(trace_id, task, source): the one task a trace's spans declare, else what its first user said.

    declared: (trace_id, task). Several different declared tasks are a conflict and give none.
    """
    d = declared.where("trim(task) <> ''").groupBy("trace_id").agg(F.countDistinct(F.trim("task")).alias("n"), F.min(F.trim("task")).alias("t"))
    d = d.select("trace_id", F.when(F.col("n") == 1, F.col("t")).alias("task"), F.when(F.col("n") == 1, "declared").otherwise("conflict").alias("source"))
    if messages is None:
        return d
    first = messages.where("role = 'user' and trim(content) <> ''").groupBy("trace_id").agg(F.min_by("content", "order").alias("_said"))
    x = d.join(first, "trace_id", "full")
    return x.select("trace_id", F.when(F.col("source").isNull(), F.col("_said")).otherwise(F.col("task")).alias("task"), F.coalesce("source", F.lit("first_user_message")).alias("source"))


def leaves(df: DataFrame, keep: Sequence[str], json: str) -> DataFrame:
    """(keep, path, value): the scalar leaves of JSON texts, JSON inside strings opened; list places become [].

    A round per level, down to the deepest; from the second on only what is still nested is read.
    """
    v = F.try_parse_json(F.col(json))
    cur = df.where(v.isNotNull()).select(*keep, F.lit("$").alias("path"), v.alias("v"))
    out = None
    while True:
        kind = F.schema_of_variant("v")
        text = F.try_variant_get("v", "$", "string")
        inner = F.when(kind.startswith("STRING") & F.substring(F.ltrim(text), 1, 1).isin("{", "["), F.try_parse_json(text))
        x = cur.withColumns({"kind": kind, "inner": inner})
        x = x.withColumns({"v": F.coalesce("inner", "v")}).withColumn("kind", F.schema_of_variant("v"))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        done = x.where(~nested).where("kind <> 'VOID'").select(*keep, "path", F.try_variant_get("v", "$", "string").alias("value"))
        out = done if out is None else out.unionByName(done)
        deeper = x.where(nested)
        if deeper.isEmpty():
            return out
        x = cut(deeper.select(*keep, "path", F.to_json("v").alias("v")), "leaves").withColumn("v", F.try_parse_json("v")).withColumn("kind", F.schema_of_variant("v"))
        obj = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("s"), e["value"].alias("v")))
        arr = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda e: F.struct(F.lit("[]").alias("s"), e.alias("v")))
        # an object read as a map, a list as an array; the other of the two is null
        cur = x.select(*keep, "path", F.explode(F.when(F.col("kind").startswith("OBJECT"), obj).otherwise(arr)).alias("e")).where("e.v is not null").select(*keep, F.concat("path", "e.s").alias("path"), F.col("e.v").alias("v"))


def field_options(df: DataFrame, key: str, json: str, names: Sequence[str]) -> DataFrame:
    """(path, records, values, rank): leaf paths that may hold a request or an answer, best first.

    Ranked by the place of their last name among names (unnamed ones last), then by how many records have them.
    """
    x = leaves(df, [key], json).where("trim(value) <> ''")
    g = x.groupBy("path").agg(F.countDistinct(key).alias("records"), F.countDistinct(F.xxhash64("value")).alias("values"))
    last = F.regexp_extract(F.lower("path"), r"([^.\[\]]+)(?:\[\])*$", 1)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), last)
    return g.withColumn("rank", F.when(rank > 0, rank).otherwise(len(names) + 1)).orderBy("rank", F.desc("records"), "path")


def tool_result_links(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Evidence tool_result: (trace_id, call_span_id, kind, target_span_id, basis) by declared call id."""
    x = calls.where("call_id is not null").select("trace_id", "call_id", F.col("span_id").alias("call_span_id"))
    y = results.where("call_id is not null").select("trace_id", "call_id", F.col("span_id").alias("target_span_id"))
    return x.join(y, ["trace_id", "call_id"]).where("call_span_id <> target_span_id").select("trace_id", "call_span_id", F.lit("tool_result").alias("kind"), "target_span_id", F.lit("call_id").alias("basis"))


def same_round_links(nodes: DataFrame) -> DataFrame:
    """Evidence same_round: nodes (trace_id, span_id, parent_span_id, round) under one parent in one round.

    Rounds can be large, so pairs aren't listed: each node is linked with the first of its round.
    """
    first = nodes.where("round is not null").groupBy("trace_id", "parent_span_id", "round").agg(F.min("span_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    x = nodes.join(first, ["trace_id", "parent_span_id", "round"]).where("span_id <> first")
    return x.select("trace_id", F.col("span_id").alias("call_span_id"), F.lit("same_round").alias("kind"), F.col("first").alias("target_span_id"), F.lit("round").alias("basis"))


def text_links(calls: DataFrame, targets: DataFrame, least: int = LEAST) -> DataFrame:
    """Evidence text_match: (trace_id, call_span_id, kind, target_span_id, basis, match_chars, shared_with).

    calls: (trace_id, span_id, output, end_ns); targets: (trace_id, span_id, text, start_ns), the text of one
    leaf. A result's text is found in a target that starts no earlier than the call ends: as a whole leaf, or
    inside it if it has at least least characters. shared_with: how many other calls the same target
    stretch fits.
    """
    c = calls.select("trace_id", F.col("span_id").alias("call_span_id"), collapse("output").alias("o"), "end_ns").where("o <> ''")
    t = targets.select("trace_id", F.col("span_id").alias("target_span_id"), collapse("text").alias("t"), "start_ns").where("t <> ''")
    when = (F.col("start_ns") >= F.col("end_ns")) & (F.col("call_span_id") != F.col("target_span_id"))
    whole = c.withColumn("h", F.xxhash64("o")).join(t.withColumn("h", F.xxhash64("t")), ["trace_id", "h"]).where(when & (F.col("o") == F.col("t")))
    # long results meet the stretches of targets that are as their beginning; only traces with such results are cut up
    long = c.where(F.length("o") >= least).withColumn("_h", F.xxhash64(F.substring("o", 1, least)))
    cut_up = t.where(F.length("t") > least).join(long.select("trace_id").distinct(), "trace_id", "left_semi")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - least + 1), lambda i: F.xxhash64(F.substring(F.col("t"), i, F.lit(least)))))
    inside = long.join(cut_up.withColumn("_h", F.explode(runs)), ["trace_id", "_h"]).where(when & (F.length("t") > F.length("o")) & F.col("t").contains(F.col("o")))
    cols = ["trace_id", "call_span_id", "target_span_id", F.length("o").alias("match_chars"), F.xxhash64("o").alias("_h")]
    x = whole.select(*cols, F.lit("whole_leaf").alias("basis")).unionByName(inside.select(*cols, F.lit("contained").alias("basis")))
    x = x.groupBy("trace_id", "call_span_id", "target_span_id").agg(F.max("match_chars").alias("match_chars"), F.max_by("basis", "match_chars").alias("basis"), F.max_by("_h", "match_chars").alias("_h"))
    n = x.groupBy("trace_id", "target_span_id", "_h").agg(F.count(F.lit(1)).alias("_n"))
    return x.join(n, ["trace_id", "target_span_id", "_h"]).select("trace_id", "call_span_id", F.when(F.col("_n") > 1, "shared_result").otherwise("text_match").alias("kind"), "target_span_id", "basis", "match_chars", (F.col("_n") - 1).alias("shared_with"))


def link_counts(links: DataFrame) -> DataFrame:
    """(kind, links, traces, most): links per kind and the most in one trace."""
    per = links.groupBy("kind", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("traces"), F.max("n").alias("most"))


def executed_between(asks: DataFrame, tools: DataFrame) -> DataFrame:
    """(trace_id, ask_span_id, n, tool_span_id): unlabelled tool spans that ran between the model call that asked
    and the next one, the nth asked for with the nth that ran. asks: (trace_id, span_id, at, n, name).
    """
    model = asks.groupBy("trace_id", "span_id").agg(F.min("at").alias("at"))
    model = model.withColumn("until", F.lead("at").over(W.partitionBy("trace_id").orderBy("at", "span_id")))
    events = tools.select("trace_id", F.col("at").alias("_at"), F.col("span_id").alias("tool_span_id"), "name", F.lit(1).alias("_k")).unionByName(model.select("trace_id", F.col("at").alias("_at"), F.col("span_id").alias("tool_span_id"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("_k")))
    w = W.partitionBy("trace_id").orderBy("_at", "_k", "tool_span_id").rowsBetween(W.unboundedPreceding, 0)
    ran = events.withColumn("ask_span_id", F.last(F.when(F.col("_k") == 0, F.col("tool_span_id")), True).over(w)).where("_k = 1 and ask_span_id is not null")
    ran = ran.withColumn("rank", F.row_number().over(W.partitionBy("trace_id", "ask_span_id", "name").orderBy("_at", "tool_span_id")))
    want = asks.withColumn("rank", F.row_number().over(W.partitionBy("trace_id", "span_id", "name").orderBy("n"))).select("trace_id", F.col("span_id").alias("ask_span_id"), "n", "name", "rank")
    return want.join(ran.select("trace_id", "ask_span_id", "name", "rank", "tool_span_id"), ["trace_id", "ask_span_id", "name", "rank"]).select("trace_id", "ask_span_id", "n", "tool_span_id")


def recovered_results(history: DataFrame, known: DataFrame) -> DataFrame:
    """(trace_id, call_id, output): results that only the histories of later calls show, first seen first.

    history: (trace_id, call_id, output, order), cumulative, so results recur; known: calls with a result already.
    """
    first = history.where("call_id is not null").groupBy("trace_id", "call_id").agg(F.min_by("output", "order").alias("output"))
    return first.join(known.select("trace_id", "call_id").distinct(), ["trace_id", "call_id"], "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(trace_id, span_id, anc_id, depth): every span with each of its ancestors, the parent at depth 1.

    nodes: (trace_id, span_id, parent_span_id). By doubling: in round k ancestors up to depth 2^k are known, so a trace
    of depth d takes log2(d) rounds. A parent that isn't there ends the line; on a circle a span meets itself and stops.
    """
    up = nodes.select("trace_id", "span_id", F.col("parent_span_id").alias("anc_id")).where("anc_id is not null and anc_id <> span_id").distinct()
    up = up.join(nodes.select("trace_id", F.col("span_id").alias("anc_id")).distinct(), ["trace_id", "anc_id"], "left_semi")
    known = cut(up.withColumn("depth", F.lit(1)), "ancestors")
    while True:
        top = known.agg(F.max("depth")).first()[0] or 0
        far = known.select("trace_id", F.col("span_id").alias("anc_id"), F.col("anc_id").alias("_next"), F.col("depth").alias("_more"))
        new = known.where(F.col("depth") == top).join(far, ["trace_id", "anc_id"]).where("_next <> span_id").select("trace_id", "span_id", F.col("_next").alias("anc_id"), (F.col("depth") + F.col("_more")).alias("depth"))
        new = cut(new.groupBy("trace_id", "span_id", "anc_id").agg(F.min("depth").alias("depth")).join(known.select("trace_id", "span_id", "anc_id"), ["trace_id", "span_id", "anc_id"], "left_anti"), "ancestors")
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def nearest_enclosing(lineage: DataFrame, flagged: Column) -> DataFrame:
    """(trace_id, span_id, enclosing): the nearest flagged ancestor, from (trace_id, span_id, anc_id, depth, …)."""
    return lineage.where(flagged).groupBy("trace_id", "span_id").agg(F.min_by("anc_id", "depth").alias("enclosing"))
