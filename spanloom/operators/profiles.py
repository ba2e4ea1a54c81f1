"""What a corpus shows of its fields: label fields, enumerated and optional arguments, branch keys, wrap-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def field_profile(leaves: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(by, path, records, values, share, repetition) of leaves (key, path, value): in which share of the records a
    path stands and how many records a value has on average.
    """
    by = by or []
    total = leaves.groupBy(*by).agg(F.countDistinct(key).alias("_t"))
    g = leaves.groupBy(*by, "path").agg(F.countDistinct(key).alias("records"), F.countDistinct("value").alias("values"))
    x = g.join(total, by) if by else g.crossJoin(F.broadcast(total))
    return x.select(*by, "path", "records", "values", (F.col("records") / F.col("_t")).alias("share"), (F.col("records") / F.col("values")).alias("repetition"))


def label_fields(leaves: DataFrame, key: str, by: list[str] | None = None, share: float = 0.8, most: int = 12, repetition: float = 3.0) -> DataFrame:
    """Paths that look like labels: in most records, with few values that recur."""
    return field_profile(leaves, key, by).where((F.col("share") >= share) & (F.col("values") <= most) & (F.col("values") >= 2) & (F.col("repetition") >= repetition))


def enumerated_arguments(args: DataFrame, least: int = 5, most: int = 8) -> DataFrame:
    """(tool, name, values): arguments (tool, name, value) seen often with few values. The list is bounded by most."""
    n = args.where("value is not null").groupBy("tool", "name", "value").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("tool", "name").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where((F.col("k") <= most) & (F.col("n") >= least * F.col("k")))
    return n.join(g.select("tool", "name"), ["tool", "name"], "left_semi").groupBy("tool", "name").agg(F.sort_array(F.collect_list("value")).alias("values"))


def optional_arguments(calls: DataFrame, args: DataFrame) -> DataFrame:
    """(tool, name, share): arguments that calls of a tool leave out at times."""
    total = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("_t"))
    return args.groupBy("tool", "name").agg(F.countDistinct("call").alias("n")).join(total, "tool").where("n < _t").select("tool", "name", (F.col("n") / F.col("_t")).alias("share"))


def loose_types(args: DataFrame) -> DataFrame:
    """(tool, name, types): arguments written with more than one JSON type."""
    g = args.where("kind is not null").groupBy("tool", "name").agg(F.sort_array(F.collect_set("kind")).alias("types"))  # at most as many as there are types
    return g.where(F.size("types") > 1)


def branch_keys(results: DataFrame, least: int = 3) -> DataFrame:
    """(tool, path, value, next_tool, n): result values after which the next call differs by value.

    results: leaves of results (tool, path, value, next_tool), next_tool being the call that followed.
    """
    n = results.groupBy("tool", "path", "value", "next_tool").agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy("tool", "path", "value").agg(F.max_by("next_tool", F.struct("n", F.col("next_tool"))).alias("next_tool"), F.sum("n").alias("n")).where(F.col("n") >= least)
    split = most.groupBy("tool", "path").agg(F.countDistinct(F.coalesce("next_tool", F.lit(""))).alias("ways"), F.count(F.lit(1)).alias("k")).where("ways > 1 and k <= 8")
    return most.join(split.select("tool", "path"), ["tool", "path"], "left_semi")


def rule_violations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """values (id, tool, name, value) that an enumerated argument (tool, name, values) doesn't list."""
    return values.join(rules, ["tool", "name"]).where(~F.array_contains("values", F.col("value"))).select("id", "tool", "name", "value")


def wrap_ups(turns: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """(text, n, rate): how user turns (traj, pos, text) end conversations, if often enough."""
    last = turns.groupBy("traj").agg(F.max_by(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), "pos").alias("text"))
    total = last.agg(F.count(F.lit(1)).alias("_t"))
    x = last.groupBy("text").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    return x.where(F.col("n") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("_t"))).select("text", "n", (F.col("n") / F.col("_t")).alias("rate"))


def answer_stats(leaves: DataFrame, group: str, top: int = 15, most: int = 30) -> DataFrame:
    """(group, path, value, n, mean): the top values of paths with few of them, the mean of numeric ones."""
    n = leaves.groupBy(group, "path", "value").agg(F.count(F.lit(1)).alias("n"))
    per = leaves.groupBy(group, "path").agg(F.countDistinct("value").alias("k"), F.avg(F.col("value").try_cast("double")).alias("mean"), F.count(F.when(F.col("value").try_cast("double").isNull(), 1)).alias("texts"))
    ranked = n.withColumn("r", F.row_number().over(W.partitionBy(group, "path").orderBy(F.desc("n"), "value"))).where(F.col("r") <= top)
    few = ranked.join(per.where(F.col("k") <= most), [group, "path"]).select(group, "path", "value", "n", F.lit(None).cast("double").alias("mean"))
    numbers = per.where("texts = 0").select(group, "path", F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("n"), "mean")
    return few.unionByName(numbers)


def never_called(offered: DataFrame, called: DataFrame) -> DataFrame:
    """(group, tool) offered but never called."""
    return offered.select("group", "tool").distinct().join(called.select("group", "tool").distinct(), ["group", "tool"], "left_anti")


def untried_pairs(items: DataFrame, options: DataFrame, ledger: DataFrame, item: str, option: str) -> DataFrame:
    """Pairs of an item with an option it is eligible for (equal `kind`) that the ledger lacks."""
    return items.join(options, "kind").join(ledger.select(item, option).distinct(), [item, option], "left_anti").select(item, option)


def round_robin(weights: dict[str, float], n: int) -> list[str]:
    """Smooth weighted round robin: n picks, each part about as often as its weight says and well spread."""
    at, total, out = dict.fromkeys(weights, 0.0), sum(weights.values()), []
    for _ in range(n):
        for k, w in weights.items():
            at[k] += w
        best = max(at, key=lambda k: at[k])
        at[best] -= total
        out.append(best)
    return out


def planned_jobs(seeds: DataFrame, seed: str, per_seed: int, strategies: list[str]) -> DataFrame:
    """(seed, n, strategy): jobs spread over strategies, each seed starting at another one (by hash of its key)."""
    jobs = seeds.select(seed, F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1))).alias("n"))
    at = F.pmod(F.xxhash64(F.col(seed).cast("string")) + F.col("n"), F.lit(len(strategies))).cast("int")
    return jobs.select(seed, "n", F.get(F.array(*[F.lit(s) for s in strategies]), at).alias("strategy"))


def capped_sweep(pairs: DataFrame, order: list[str], caps: dict[str, int]) -> DataFrame:
    """pairs taken greedily in order while every cap holds: caps name a column and how often one of its values may appear.

    order has to be total. Exactly what taking them one by one gives, told in rounds: an open pair is taken once it would
    fit even if all open ones before it were taken, and thrown out once those taken before it fill a cap. The first open
    pair is settled in every round. Pairs thrown out use up no cap; what is settled isn't read as open again.
    """
    from spanloom.session import cut

    state = cut(pairs.withColumn("_taken", F.lit(False)), "sweep")
    while not state.where("not _taken").isEmpty():
        x, fits, full = state, F.lit(True), F.lit(False)
        for i, (c, most) in enumerate(caps.items()):
            before = W.partitionBy(c).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
            x = x.withColumns({f"_all{i}": F.count(F.lit(1)).over(before), f"_had{i}": F.coalesce(F.sum(F.col("_taken").cast("int")).over(before), F.lit(0))})
            fits, full = fits & (F.col(f"_all{i}") < most), full | (F.col(f"_had{i}") >= most)
        x = x.where(F.col("_taken") | ~full).withColumn("_taken", F.col("_taken") | fits)
        state = cut(x.select(*pairs.columns, "_taken"), "sweep")
    return state.drop("_taken")
