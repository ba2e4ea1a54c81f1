"""Labelled decisions: import with quarantine, predictions, merges, leakage between splits, prompts.

A decision is a question with ordered options and a target: one option, or a share per option. Options
keep their order as an array; nothing here relies on the order of a map.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalars import digest_id, hash_order
from spanloom.operators.evaluation import hash_split

MOST_OPTIONS = 26
SUM_SLACK = 1e-6
SCHEMA = "file string, pos int, decision_id string, question string, state string, options array<struct<id: string, text: string>>, target array<struct<id: string, p: double>>, split string, group_id string, source string, problems array<string>"


def one_decision(record: str) -> tuple:
    """(id, question, state, options, target, split, group, source, problems) of one JSON record."""
    none = (None, None, None, [], [], None, None, None)
    try:
        r = json.loads(record)
    except ValueError:
        return (*none, ["malformed"])
    if not isinstance(r, dict):
        return (*none, ["not_an_object"])
    bad = []
    question = r.get("question") if isinstance(r.get("question"), str) and r["question"].strip() else None
    if question is None:
        bad.append("no_question")
    raw = r.get("options")
    options = [(str(k), str(v)) for k, v in raw.items()] if isinstance(raw, dict) else [(str(x.get("id")), str(x.get("text", x.get("description", "")))) for x in raw if isinstance(x, dict)] if isinstance(raw, list) else []
    ids = [k for k, _ in options]
    if len(options) < 2:
        bad.append("fewer_than_two_options")
    if len(options) > MOST_OPTIONS:
        bad.append("too_many_options")
    if len(set(ids)) < len(ids):
        bad.append("repeated_option")
    t = r.get("target")
    if isinstance(t, str):
        target = [(t, 1.0)]
    elif isinstance(t, dict) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in t.values()):
        target = [(str(k), float(v)) for k, v in t.items()]
    else:
        target = []
        bad.append("no_target")
    if any(k not in ids for k, _ in target):
        bad.append("target_not_an_option")
    if target and (any(p < 0 for _, p in target) or abs(sum(p for _, p in target) - 1) > SUM_SLACK):
        bad.append("target_not_a_distribution")
    text = lambda k: r.get(k) if isinstance(r.get(k), str) else None
    state = r.get("state")
    return text("id"), question, state if isinstance(state, str) or state is None else json.dumps(state, ensure_ascii=False), options, target, text("split"), text("group_id"), text("source"), bad


def parsed(records: DataFrame) -> DataFrame:
    """Decisions of (file, pos, record), each with the problems that speak against it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, pos, record in zip(f["file"], f["pos"], f["record"]):
                i, q, s, o, t, sp, g, src, bad = one_decision(record)
                rows.append((file, pos, i, q, s, [{"id": k, "text": v} for k, v in o], [{"id": k, "p": v} for k, v in t], sp, g, src, bad))
            yield pd.DataFrame(rows, columns=["file", "pos", "decision_id", "question", "state", "options", "target", "split", "group_id", "source", "problems"])

    x = records.where("record is not null").select("file", "pos", "record").mapInPandas(run, SCHEMA)
    own = digest_id([F.col("question"), F.col("state"), F.to_json("options")])
    return x.withColumn("decision_id", F.coalesce("decision_id", own))


def imported(records: DataFrame, forced_split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantine with reason). A group's rows without split get one by hash of the group."""
    x = parsed(records)
    digest = digest_id([F.col("question"), F.col("state"), F.to_json("options")])
    x = x.withColumns({"_c": digest, "_t": F.to_json(F.array_sort("target"))})
    ids = x.groupBy("decision_id").agg(F.count(F.lit(1)).alias("_ids"))
    # a record that is no decision says nothing about the others
    good = x.where(F.size("problems") == 0)
    same = good.groupBy("_c").agg(F.countDistinct("_t").alias("_targets"), F.min(F.struct("file", "pos")).alias("_first"))
    groups = good.where("group_id is not null").groupBy("group_id").agg(F.countDistinct("split").alias("_splits"))
    y = x.join(ids, "decision_id").join(same, "_c", "left").join(groups, "group_id", "left")
    reason = F.when(F.size("problems") > 0, F.array_join("problems", ",")).when(F.col("_targets") > 1, "conflicting_targets").when(F.col("_first") != F.struct("file", "pos"), "repeated_content").when(F.col("_ids") > 1, "duplicate_id").when(F.col("_splits") > 1, "group_in_several_splits")
    y = y.withColumn("reason", reason)
    split = hash_split(F.coalesce("group_id", "decision_id"), [("train", 0.7), ("calibration", 0.8), ("validation", 0.9)], "test")
    cols = [c.split()[0] for c in SCHEMA.split(", ") if not c.startswith(("p:", "text:"))]
    cols = ["file", "pos", "decision_id", "question", "state", "options", "target", "split", "group_id", "source"]
    kept = y.where("reason is null").withColumn("split", F.lit(forced_split) if forced_split else F.coalesce("split", split)).select(cols)
    return kept, y.where("reason is not null").select(*cols, "reason")


def predictions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, probabilities, rejection): every decision with its prediction or why there is none."""
    g = lambda p: F.get_json_object("record", p)
    p = F.from_json(g("$.probabilities"), "map<string,double>")
    x = records.where(g("$.decision_id").isNotNull()).select(g("$.decision_id").alias("decision_id"), F.map_entries(p).alias("e"))
    n = x.groupBy("decision_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.array_sort("e")).alias("e"))
    y = decisions.select("decision_id", F.transform("options", lambda o: o["id"]).alias("_o")).join(n, "decision_id", "left")
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + F.coalesce(v["value"], F.lit(0.0)))
    keys = F.transform("e", lambda v: v["key"])
    why = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(F.col("e").isNull(), "unreadable").when(F.size(F.array_except(keys, "_o")) > 0, "unknown_option").when(F.size(F.array_except("_o", keys)) > 0, "missing_option").when((F.abs(total - 1) > 1e-3) | F.exists("e", lambda v: v["value"] < 0), "not_a_distribution")
    return y.withColumn("rejection", why).select("decision_id", F.when(F.col("rejection").isNull(), F.transform("e", lambda v: F.struct(v["key"].alias("id"), v["value"].alias("p")))).alias("probabilities"), "rejection")


def rejection_reasons(p: DataFrame) -> DataFrame:
    """(reason, n), digits taken out."""
    return p.where("rejection is not null").groupBy(F.regexp_replace("rejection", "[0-9]+", "N").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def merged(parts: list[DataFrame], key: str = "decision_id") -> tuple[DataFrame, DataFrame]:
    """(union, clashes): keys that stand in more than one row come out as clashes and nowhere else."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p, allowMissingColumns=True)
    twice = x.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.join(twice, key, "left_anti"), twice


def leaked(held: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n): values of any of the keys that stand on both sides."""
    out = None
    for k in keys:
        a = held.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        x = a.join(train.select(F.col(k).cast("string").alias("value")).distinct(), "value", "left_semi").select(F.lit(k).alias("key"), "value", "n")
        out = x if out is None else out.unionByName(x)
    return out


def majority(decisions: DataFrame) -> DataFrame:
    """(split, n, label, labelled): each split's most frequent leading option; 'tie' where options share the lead."""
    top = F.array_max(F.transform("target", lambda t: t["p"]))
    lead = F.filter("target", lambda t: t["p"] == top)
    x = decisions.withColumn("label", F.when(F.size(lead) == 1, F.get(lead, F.lit(0))["id"]).otherwise("tie"))
    n = x.groupBy("split", "label").agg(F.count(F.lit(1)).alias("labelled"))
    t = n.groupBy("split").agg(F.sum("labelled").alias("n"), F.max_by("label", F.struct("labelled", F.hash("label"))).alias("label"), F.max("labelled").alias("labelled"))
    return t.select("split", "n", "label", "labelled")


def train_prior(decisions: DataFrame, split: str = "train") -> DataFrame:
    """(id, p): the mean target of a split; options a decision lacks count as 0."""
    x = decisions.where(F.col("split") == split)
    total = x.agg(F.count(F.lit(1)).alias("t"))
    return x.select(F.explode("target").alias("t_")).groupBy("t_.id").agg(F.sum("t_.p").alias("s")).crossJoin(F.broadcast(total)).select("id", (F.col("s") / F.col("t")).alias("p"))


def prompt(question: Column | str = "question", options: Column | str = "options") -> Column:
    """The question with lettered options."""
    q, o = (F.col(c) if isinstance(c, str) else c for c in (question, options))
    letters = F.transform(o, lambda x, i: F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1)), F.lit(". "), x["text"]))
    return F.concat(q, F.lit("\n\n"), F.array_join(letters, "\n"), F.lit("\n\nAnswer:"))


def training_order(decisions: DataFrame, epoch: int, seed: str = "t") -> DataFrame:
    """decisions with order_key and options reordered: a pseudo-random order per epoch that any engine repeats."""
    key = hash_order(f"{seed}|{epoch}", "decision_id")
    shuffled = F.transform(F.array_sort(F.transform("options", lambda o: F.struct(F.sha2(F.concat_ws("|", F.lit(f"{seed}|{epoch}"), "decision_id", o["id"]), 256).alias("k"), o.alias("o")))), lambda s: s["o"])
    return decisions.withColumns({"order_key": key, "options": shuffled})
