"""Evaluation statistics: scores, reliability, ranks, bootstrap, splits, quantiles.

Rows with a null probability, score or label count for nothing unless a function says otherwise; a
statistic over no rows is null. All are combinable aggregates; ranks over a whole table go through
prefix sums, so no task sees all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import hex_int
from spanloom.operators.prefix import running

FLOOR = 1e-15  # least probability under a logarithm
BLOCK = 256  # actions of a history that are gathered at once


def nll(p: Column, y: Column) -> Column:
    """Negative log likelihood of a binary outcome."""
    q = F.when(y == 1, p).otherwise(1 - p)
    return -F.log(F.greatest(q, F.lit(FLOOR)))


def binary_scores(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, brier, nll)."""
    x = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(nll(F.col(p), F.col(y))).alias("nll"))


def reliability_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate): equal widths, empty bins included."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("bigint")
    x = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return all_bins.join(x, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(ece)."""
    b = reliability_bins(df, p, y, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def tops(options: DataFrame, key: str, option: str, p: str, pos: str) -> DataFrame:
    """(key, top, gold, ties): the first likeliest option, and null gold if several share the lead."""
    best = options.groupBy(key).agg(F.max(p).alias("_max"))
    x = options.join(best, key).where(F.col(p) == F.col("_max"))
    y = x.groupBy(key).agg(F.min_by(option, pos).alias("top"), F.count(F.lit(1)).alias("ties"))
    return y.select(key, "top", F.when(F.col("ties") == 1, F.col("top")).alias("gold"), "ties")


def macro_f1(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(labels, macro_f1) over all labels seen as gold or predicted."""
    x = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(predicted).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    each = x.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.when(F.col("g") == F.col("q"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("gold"), F.lit(0).alias("said")), F.struct(F.col("q").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("said")))).alias("e")).select("e.*")
    per = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("gold").alias("gold"), F.sum("said").alias("said"))
    return per.agg(F.count(F.lit(1)).alias("labels"), F.avg(2.0 * F.col("tp") / (F.col("gold") + F.col("said"))).alias("macro_f1"))


def total_variation(df: DataFrame, group: str, option: str) -> DataFrame:
    """(group, tv): distance of each group's mix of options from the mix of all."""
    n = df.groupBy(group, option).agg(F.count(F.lit(1)).alias("n"))
    by_group, by_option = n.groupBy(group).agg(F.sum("n").alias("gn")), n.groupBy(option).agg(F.sum("n").alias("on"))
    total = n.agg(F.sum("n").alias("tn"))
    # options a group lacks: their whole share differs, so only the present ones need a row
    x = n.join(by_group, group).join(by_option, option).crossJoin(F.broadcast(total))
    here, all_ = F.col("n") / F.col("gn"), F.col("on") / F.col("tn")
    y = x.groupBy(group).agg(F.sum(F.abs(here - all_)).alias("d"), F.sum(all_).alias("seen"))
    return y.select(group, ((F.col("d") + 1 - F.col("seen")) / 2).alias("tv"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(positives, negatives, auc): ties count half. null without both classes."""
    x = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("q"))
    r = running(x, ["s"], {"below": F.col("q")})
    y = r.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p").cast("double") * (F.col("below") + F.col("q") / 2)).alias("u"))
    return y.select("positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("u") / (F.col("positives").cast("double") * F.col("negatives"))).alias("auc"))


def auc_within(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(groups, mean_auc) over groups that have both classes. Rows are first counted per score."""
    x = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(group, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(group).orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    y = x.withColumn("u", F.col("p") * (below + F.col("q") / 2)).groupBy(group).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return y.where("p > 0 and q > 0").agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("u") / (F.col("p") * F.col("q"))).alias("mean_auc"))


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, mean_a, mean_b, mean_diff) over the keys of a; what b lacks counts as 0 (a missing prediction is wrong)."""
    x = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key, "left").withColumn("vb", F.coalesce("vb", F.lit(0)))
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.avg(F.col("va") - F.col("vb")).alias("mean_diff"))


def drawn(draws: int, slots: int, seed: str, spark) -> DataFrame:
    """(draw, idx, times): how often each of slots groups is drawn, from sha-256 of seed, draw and slot."""
    x = spark.range(draws).withColumnRenamed("id", "draw").select("draw", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    idx = hex_int(F.concat(F.lit(seed + "|"), F.col("draw").cast("string"), F.lit("|"), F.col("slot").cast("string")), 8) % slots
    return x.groupBy("draw", idx.alias("idx")).agg(F.count(F.lit(1)).alias("times"))


def bootstrap(df: DataFrame, group: str, value: str, draws: int = 200, seed: str = "b") -> DataFrame:
    """(mean, low, high): grouped percentile bootstrap at 95 %.

    Groups are summed first and numbered in their order range by range, so their number is not bounded by one task.
    """
    per = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    per = running(per, [group], {"idx": F.lit(1)}).withColumn("idx", F.col("idx").cast("bigint"))
    slots = per.count()
    if not slots:
        return per.agg(F.max("s").alias("mean"), F.max("s").alias("low"), F.max("s").alias("high"))
    means = drawn(draws, slots, seed, df.sparkSession).join(per, "idx").groupBy("draw").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    ranked = means.withColumn("k", F.row_number().over(W.orderBy("m", "draw")) - 1)  # one row per draw
    low, high = int(0.025 * (draws - 1)), int(0.975 * (draws - 1))
    ends = ranked.agg(F.max(F.when(F.col("k") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("k") == high, F.col("m"))).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(ends)


def positional(df: DataFrame, by: Sequence[str], value: str, rules: dict[str, str]) -> DataFrame:
    """(by, n, one column per rule): exact quantiles by position.

    rules: name -> SQL for the 0-based place among n sorted values, e.g. 'floor(n / 2)' or
    'ceil(0.95 * n - 1e-9) - 1'. Values are counted per group first, so ties cost one row.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by).orderBy("_x")
    x = x.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    n = x.groupBy(*by).agg(F.sum("_c").alias("n"))
    y = x.join(F.broadcast(n) if not by else n, list(by)) if by else x.crossJoin(F.broadcast(n))
    picks = []
    for name, rule in rules.items():
        k = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.expr(rule).cast("bigint")))
        picks.append(F.max(F.when((k >= F.col("_from")) & (k < F.col("_to")), F.col("_x"))).alias(name))
    return y.groupBy(*by, "n").agg(*picks)


#: The conventions in use, as rules of positional().
NEAREST_RANK = "ceil({q} * n - 1e-9) - 1"
HALF, P99 = "floor(n / 2)", "least(n - 1, floor(0.99 * n))"
P90_INNER = "floor(0.9 * (n - 1))"


def entropy(df: DataFrame, by: Sequence[str], option: str) -> DataFrame:
    """(by, kinds, bits): Shannon entropy of the options of each group."""
    n = df.groupBy(*by, option).agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy(*by).agg(F.sum("n").alias("t"))
    x = n.join(t, list(by)) if by else n.crossJoin(F.broadcast(t))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds"), (-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias("bits"))


def _blocks(df: DataFrame, by: str, order: Sequence[str], action: str) -> DataFrame:
    """df with _k, how many actions (null is none) the group has before the row, and _b, the block of BLOCK actions that is."""
    before = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = df.withColumn("_k", F.count(action).over(before))
    return x.withColumn("_b", F.floor(F.col("_k") / BLOCK))


def _digests(x: DataFrame, by: str, action: str) -> DataFrame:
    """(by, _b, _d): a digest of each block's actions in order."""
    own = F.sort_array(F.collect_list(F.when(F.col(action).isNotNull(), F.struct("_k", F.col(action).cast("string").alias("a")))))
    return x.groupBy(by, "_b").agg(F.when(F.size(own) > 0, F.sha2(F.to_json(own["a"]), 256)).alias("_d"))


def signatures(df: DataFrame, by: str, order: Sequence[str], action: str) -> DataFrame:
    """(by, sig): one value per different whole list of actions in order, the digests of its blocks."""
    d = _digests(_blocks(df, by, order, action), by, action)
    return d.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_b", "_d")))["_d"], "").alias("sig"))


def histories(df: DataFrame, by: str, order: Sequence[str], action: str) -> DataFrame:
    """df with evidence: all actions of the group before the row, in order, joined by '>'.

    From BLOCK actions on, the full blocks stand as one digest before the rest, so that a hot group's rows don't each
    hold its whole history; two histories are the same text only if they are the same list.
    """
    x = _blocks(df, by, order, action)
    earlier = W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    full = _digests(x, by, action).withColumn("_full", F.collect_list("_d").over(earlier)).where("_b > 0")
    full = full.select(F.col(by).alias("_by"), F.col("_b").alias("_bb"), F.sha2(F.array_join("_full", ""), 256).alias("_full"))
    own = W.partitionBy(by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_own", F.array_join(F.collect_list(action).over(own), ">"))
    x = x.join(full, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bb")), "left")
    return x.withColumn("evidence", F.concat_ws(">", "_full", "_own")).select(*df.columns, "evidence")


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """df with advantage: reward less its group's mean. The means are combined before the join."""
    means = df.groupBy(group).agg(F.avg(reward).alias("_mean"))
    return df.join(means, group).withColumn("advantage", F.col(reward) - F.col("_mean")).drop("_mean")


def vote_shares(df: DataFrame, key: str, vote: str) -> DataFrame:
    """(key, vote, share): votes as a soft target."""
    n = df.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy(key).agg(F.sum("n").alias("t")), key).select(key, vote, (F.col("n") / F.col("t")).alias("share"))


def agreement(df: DataFrame, truth: str, verdict: str) -> DataFrame:
    """(n, agree, false_accept, false_reject) of boolean verdicts; rows without a verdict are left out."""
    x = df.where(F.col(verdict).isNotNull() & F.col(truth).isNotNull())
    return x.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(truth) == F.col(verdict), 1)).alias("agree"), F.count(F.when(F.col(verdict) & ~F.col(truth), 1)).alias("false_accept"), F.count(F.when(~F.col(verdict) & F.col(truth), 1)).alias("false_reject"))


def capped_rewards(df: DataFrame, by: str, order: Sequence[str], reward: str, most: float) -> DataFrame:
    """df with capped: gains and losses each count until their running sum reaches most."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    gain, loss = F.greatest(F.col(reward), F.lit(0.0)), F.greatest(-F.col(reward), F.lit(0.0))
    up, down = F.sum(gain).over(w), F.sum(loss).over(w)
    step = lambda run, v: F.least(run, F.lit(most)) - F.least(run - v, F.lit(most))
    return df.withColumn("capped", step(up, gain) - step(down, loss))


def hash_split(key: Column, cuts: Sequence[tuple[str, float]], rest: str) -> Column:
    """Split by the first byte of sha-256: the first name whose upper bound exceeds byte / 256, else rest."""
    u = hex_int(key, 2) / 256
    out = F.when(u < cuts[0][1], cuts[0][0])
    for name, upper in cuts[1:]:
        out = out.when(u < upper, name)
    return out.otherwise(rest)


def bucket_of(key: Column, buckets: int, digits: int = 8) -> Column:
    """A bucket from the first hex digits of sha-256."""
    return F.pmod(hex_int(key, digits), F.lit(buckets))


def held_out(key: Column, parts: int = 3) -> Column:
    """Whether the first 8 bytes of sha-256, as an unsigned number, are divisible by parts."""
    big = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return big % F.lit(parts).cast("decimal(20,0)") == 0


def tempered_nll(logits: DataFrame, temperatures: Sequence[float]) -> list[float]:
    """Mean NLL of the gold option at each temperature, all in one pass. logits: (logits array<double>, gold int)."""
    cols = []
    for i, t in enumerate(temperatures):
        z = F.transform("logits", _over(t))
        top = F.array_max(z)
        log_sum = F.log(F.aggregate(z, F.lit(0.0), _plus_exp(top))) + top
        cols.append(F.avg(log_sum - F.get(z, F.col("gold"))).alias(f"t{i}"))
    row = logits.where("logits is not null and gold is not null").agg(*cols).first()
    return list(row)


def _over(t: float):
    return lambda v: v / t


def _plus_exp(top: Column):
    return lambda a, v: a + F.exp(v - top)


def fit_temperature(logits: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 41, rounds: int = 4) -> float | None:
    """The temperature of the lowest mean NLL: a log grid, narrowed around its best point in each round."""
    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        losses = tempered_nll(logits, [math.exp(g) for g in grid])
        if losses[0] is None:
            return None
        k = min(range(points), key=lambda i: losses[i])
        a, b = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return math.exp((a + b) / 2)
