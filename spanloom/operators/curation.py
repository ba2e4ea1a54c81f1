"""Selection and structure checks on made or collected items: eligibility, overrides, packages, gates, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import shingles, words
from spanloom.operators.prefix import ranked


def reasons(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that don't hold, in order; null counts as not holding."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in conditions.items()]))


def applicable(items: DataFrame, variations: DataFrame) -> DataFrame:
    """(item_id, variation): items (item_id, label, called array) a variation (variation, applies_to array, needs array)
    fits: its label is listed (or nothing is) and every needed tool was called. variations is a small table.
    """
    listed = (F.size("applies_to") == 0) | F.array_contains("applies_to", F.col("label"))
    return items.join(variations, listed & (F.size(F.array_except("needs", "called")) == 0)).select("item_id", "variation")


def overridden(spans: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, unmatched): roles replaced by those given per name (name, role); names that no span has come out apart."""
    o = overrides.select("name", F.col("role").alias("_role")).dropDuplicates(["name"])
    out = spans.join(o, "name", "left").withColumn("role", F.coalesce("_role", "role")).drop("_role").select(spans.columns)
    return out, overrides.join(spans.select("name").distinct(), "name", "left_anti")


def siblings(items: DataFrame, key: str, group: str, most: int = 2) -> DataFrame:
    """(key, sibling): up to most other items of the same group, the nearest in order of key after it, then from the start."""
    x = ranked(items.where(F.col(group).isNotNull()), group, [key], "_at", "_n")
    want = x.select(group, key, "_n", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), "_at").where("k < _n").withColumn("_to", (F.col("_at") + F.col("k")) % F.col("_n"))
    to = x.select(group, F.col(key).alias("sibling"), F.col("_at").alias("_to"))
    return want.join(to, [group, "_to"]).select(key, "sibling")


def index_breaks(results: DataFrame, conv: Sequence[str], tag: str = "result") -> DataFrame:
    """(conv, idx, said, is): results whose running number in the text ([tag:N]) isn't their place."""
    n = F.row_number().over(W.partitionBy(*conv).orderBy("idx"))
    said = F.regexp_extract("content", rf"\[{tag}:(\d+)\]", 1).try_cast("int")
    return results.withColumns({"is": n, "said": said}).where(F.col("said").isNull() | (F.col("said") != F.col("is"))).select(*conv, "idx", "said", "is")


def copied_rows(rubric: DataFrame, seeds: DataFrame, text: str, n: int = 8) -> DataFrame:
    """(row_id, gram): n-grams of a rubric's rows that stand in a seed text word for word."""
    grams = lambda d, *k: d.select(*k, words(text).alias("_w")).where(F.size("_w") >= n).select(*k, F.explode(shingles("_w", n, "none")).alias("gram"))
    return grams(rubric, "row_id").join(grams(seeds).distinct(), "gram", "left_semi").select("row_id", "gram")


def words_covered(quote: Column, source: Column) -> Column:
    """Share of a quote's words that its source has; 0 for an empty quote. Arrays of words."""
    return F.when(F.size(quote) > 0, F.size(F.filter(quote, lambda w: F.array_contains(source, w))) / F.size(quote)).otherwise(F.lit(0.0))


def fidelity(made: DataFrame, seeds: DataFrame) -> DataFrame:
    """(item_id, same_tools, order_kept, extra_tools): how the calls of a made item (item_id, seed_id, tools array)
    follow its seed's (seed_id, tools).
    """
    x = made.join(seeds.select("seed_id", F.col("tools").alias("_s")), "seed_id", "left")
    shared = F.filter("tools", lambda t: F.array_contains("_s", t))
    seed_shared = F.filter("_s", lambda t: F.array_contains("tools", t))
    return x.select("item_id", (F.size(F.array_except("_s", "tools")) == 0).alias("same_tools"), (F.array_distinct(shared) == F.array_distinct(seed_shared)).alias("order_kept"), F.array_sort(F.array_except("tools", "_s")).alias("extra_tools"))


def exempted(leaks: DataFrame, labels: DataFrame) -> DataFrame:
    """leaks (task_id, value, …) without values that are common label words (task_id, label) of the task."""
    return leaks.withColumn("_l", F.lower(F.trim("value"))).join(labels.select("task_id", F.lower(F.trim("label")).alias("_l")).distinct(), ["task_id", "_l"], "left_anti").drop("_l")


def structure(files: DataFrame, needed: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """(task_id, problem, path): needed paths (regexes) a package lacks, paths outside the allowed ones, unsafe and repeated paths."""
    p = F.col("path")
    odd = F.array_compact(F.array(F.when(p.startswith("/") | p.contains(".."), "unsafe_path"), F.when(~p.rlike("^(?:" + "|".join([*needed, *allowed]) + ")$"), "unexpected_path")))
    found = files.select("task_id", "path", F.explode(odd).alias("problem")).select("task_id", "problem", "path")
    twice = files.groupBy("task_id", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id", F.lit("repeated_path").alias("problem"), "path")
    has = files.groupBy("task_id").agg(*[F.max(p.rlike(f"^(?:{n})$").cast("int")).alias(f"_{i}") for i, n in enumerate(needed)])
    lacks = has.select("task_id", F.explode(F.array_compact(F.array(*[F.when(F.col(f"_{i}") == 0, n) for i, n in enumerate(needed)]))).alias("path")).select("task_id", F.lit("missing_path").alias("problem"), "path")
    return found.unionByName(twice).unionByName(lacks)


def gate_verdicts(outcomes: DataFrame) -> DataFrame:
    """(task_id, gate, verdict) from runs (task_id, gate, item, trial, state, reward).

    oracle and alternatives have to score 1 every time, noop and wrong 0 every time, stability the same in all
    trials of an item. A run that didn't end is an error, and an error is never a verdict.
    """
    per = outcomes.groupBy("task_id", "gate", "item").agg(F.count(F.when(F.col("state") != "done", 1)).alias("bad"), F.min("reward").alias("lo"), F.max("reward").alias("hi"))
    ok = F.when(F.col("gate").isin("oracle", "alternatives"), F.col("lo") == 1).when(F.col("gate").isin("noop", "wrong"), F.col("hi") == 0).otherwise(F.col("lo") == F.col("hi"))
    g = per.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("task_id", "gate").agg(F.sum("bad").alias("bad"), F.min(F.col("ok").cast("int")).alias("ok"))
    return g.select("task_id", "gate", F.when(F.col("bad") > 0, "error").when(F.col("ok") == 1, "pass").otherwise("fail").alias("verdict"))


def attributed(ledger: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decision sums, refused): ledger calls (trace_id, turn, tokens, failed) summed per decision (decision_id, trace_id,
    turn). Turns that more than one decision claims are refused, not split.
    """
    claims = decisions.groupBy("trace_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("decision_id").alias("decision_id"))
    sums = ledger.groupBy("trace_id", "turn").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("failed"), 1)).alias("failures"), F.sum("tokens").alias("tokens"))
    x = claims.join(sums, ["trace_id", "turn"])
    return x.where("n = 1").select("decision_id", "calls", "failures", "tokens"), x.where("n > 1").select("trace_id", "turn", "n")


def rendered(m: DataFrame, *conv: str, most: int = 2000) -> DataFrame:
    """(conv, text): a conversation as numbered lines, results cut after most characters. A conversation has to fit a row."""
    body = F.coalesce(F.col("content"), F.lit(""))
    cut = F.when((F.col("role") == "tool") & (F.length(body) > most), F.concat(F.substring(body, 1, most), F.lit("…"))).otherwise(body)
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("role", F.lit("?")), F.lit(": "), cut, F.coalesce(F.concat(F.lit(" -> "), F.col("calls")), F.lit("")))
    x = m.groupBy(*conv).agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("rows"))
    return x.select(*conv, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
