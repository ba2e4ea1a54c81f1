"""Reports over predictions, calls, gates and seeds: one combinable aggregate per figure.

Options of a decision are rows; there are at most a few dozen of them, so what is gathered per decision is
bounded. Figures that need an order (quantiles, intervals) count values before they sort. A figure without
rows is null. Empty tables give empty reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import cause, hash_order
from spanloom.operators import evaluation as E
from spanloom.session import cut


def scored_rows(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, scored, chosen, confidence, gold, nll, brier): each decision of targets under the predictions.

    targets: (id, option, pos, t); predictions: (id, option, p). The likeliest option is chosen, of equals the first by
    pos; gold is null where several options share the lead. A decision without predictions has p = 0 everywhere.
    """
    p = predictions.where("p is not null").groupBy("id", "option").agg(F.max("p").alias("p"))
    x = targets.join(p, ["id", "option"], "left").withColumns({"t": F.coalesce("t", F.lit(0.0)), "_p": F.coalesce("p", F.lit(0.0))})
    lead = F.max(F.struct("t", (-F.col("pos")).alias("pos"), "option"))
    g = x.groupBy("id").agg(
        F.max(F.col("p").isNotNull()).alias("scored"), F.max(F.struct("_p", (-F.col("pos")).alias("pos"), "option")).alias("c"), lead.alias("g"), F.collect_list("t").alias("ts"),
        F.sum(F.when(F.col("t") > 0, -F.col("t") * F.log(F.greatest("_p", F.lit(E.FLOOR)))).otherwise(0.0)).alias("nll"), F.sum(F.pow(F.col("_p") - F.col("t"), 2)).alias("brier"),
    )
    one = F.size(F.filter("ts", lambda t: t == F.col("g.t"))) == 1
    return g.select("id", "scored", F.when(F.col("scored"), F.col("c.option")).alias("chosen"), F.when(F.col("scored"), F.col("c._p")).alias("confidence"), F.when(one, F.col("g.option")).alias("gold"), "nll", "brier")


def column_report(targets: DataFrame, predictions: DataFrame, latency: DataFrame | None = None, passes: DataFrame | None = None, bins: int = 10) -> DataFrame:
    """One row: rows, coverage, accuracy, adjusted_accuracy, tied_targets, macro_f1, nll, brier, ece, order_agreement, order_shift, latency_mean, latency_p50, latency_p95, latency_rows.

    latency: (id, seconds); passes: (id, pass 0 or 1, option, pos, p), the same decision asked in two orders of its options.
    Accuracy leaves out decisions with several leading targets; the adjusted one counts those without prediction as wrong.
    """
    rows = cut(scored_rows(targets, predictions), "scored")
    told = rows.where("scored")
    right = (F.col("chosen") == F.col("gold")).cast("int")
    out = rows.agg(
        F.count(F.when(F.col("scored"), 1)).alias("rows"), F.avg(F.col("scored").cast("double")).alias("coverage"), F.avg(F.when(F.col("scored") & F.col("gold").isNotNull(), right)).alias("accuracy"),
        F.avg(F.when(F.col("gold").isNotNull(), F.coalesce(right, F.lit(0)))).alias("adjusted_accuracy"), F.count(F.when(F.col("scored") & F.col("gold").isNull(), 1)).alias("tied_targets"),
        F.avg(F.when(F.col("scored"), F.col("nll"))).alias("nll"), F.avg(F.when(F.col("scored"), F.col("brier"))).alias("brier"),
    )
    sure = told.where("gold is not null").select("chosen", "gold", "confidence", right.alias("right"))
    out = out.crossJoin(E.macro_f1(sure, "gold", "chosen").select("macro_f1")).crossJoin(E.calibration_error(sure, "confidence", "right", bins))
    none = [F.lit(None).cast("double").alias(c) for c in ("order_agreement", "order_shift")]
    if passes is None:
        out = out.select("*", *none)
    else:
        each = passes.groupBy("id").pivot("pass", [0, 1]).agg(F.max(F.struct("p", (-F.col("pos")).alias("pos"), "option"))["option"].alias("top"))
        shift = passes.groupBy("id", "option").agg((F.abs(F.sum(F.when(F.col("pass") == 0, F.col("p")).otherwise(-F.col("p")))) / 2).alias("d")).groupBy("id").agg(F.sum("d").alias("d"))
        both = each.where("`0` is not null and `1` is not null").join(shift, "id")
        out = out.crossJoin(both.agg(F.avg((F.col("0") == F.col("1")).cast("double")).alias("order_agreement"), F.avg("d").alias("order_shift")))
    if latency is None:
        return out.select("*", *[F.lit(None).cast("double").alias(f"latency_{c}") for c in ("mean", "p50", "p95")], F.lit(0).cast("bigint").alias("latency_rows"))
    lat = latency.join(told.select("id"), "id", "left_semi").where("seconds is not null").withColumn("_all", F.lit(0))
    quant = E.positional(lat, ["_all"], "seconds", {"latency_p50": E.NEAREST_RANK.format(q=0.5), "latency_p95": E.NEAREST_RANK.format(q=0.95)})
    mean = lat.groupBy("_all").agg(F.avg("seconds").alias("latency_mean"), F.count(F.lit(1)).alias("latency_rows"))
    one = out.withColumn("_all", F.lit(0)).join(mean.join(quant.select("_all", "latency_p50", "latency_p95"), "_all"), "_all", "left")
    return one.drop("_all").withColumn("latency_rows", F.coalesce("latency_rows", F.lit(0)))


def compared(targets: DataFrame, candidate: DataFrame, baseline: DataFrame, groups: DataFrame, draws: int = 200) -> DataFrame:
    """(metric, estimate, low, high): candidate less baseline over all decisions, with 95 % intervals resampled by group.

    groups: (id, grp). A decision one side lacks counts against it. Accuracy leaves out decisions with several leading targets.
    """
    side = lambda p, s: scored_rows(targets, p).select("id", "gold", *[v.alias(f"{n}_{s}") for n, v in {"accuracy": F.coalesce((F.col("chosen") == F.col("gold")).cast("double"), F.lit(0.0)), "nll": F.col("nll"), "brier": F.col("brier")}.items()])
    x = cut(side(candidate, "a").join(side(baseline, "b").drop("gold"), "id").join(groups, "id"), "compared")
    out = None
    for m in ("accuracy", "nll", "brier"):
        y = x.where("gold is not null") if m == "accuracy" else x
        y = E.bootstrap(y.withColumn("_v", F.col(f"{m}_a") - F.col(f"{m}_b")), "grp", "_v", draws).select(F.lit(m).alias("metric"), F.col("mean").alias("estimate"), "low", "high")
        out = y if out is None else out.unionByName(y)
    return out


def cost_per_thousand(runs: DataFrame, gpu_usd_per_hour: float | None = None) -> DataFrame:
    """(column, decisions, covered, usd_per_1k, basis): what a thousand decisions cost, by the best basis there is.

    runs: (column, id, usd, seconds, bill): a ledger's price per decision, else the run's bill spread over its decisions,
    else the measured time at the price of the machine.
    """
    g = runs.groupBy("column").agg(F.count(F.lit(1)).alias("decisions"), F.count("usd").alias("covered"), F.avg("usd").alias("_ledger"), F.max("bill").alias("_bill"), F.avg("seconds").alias("_s"))
    hour = F.lit(gpu_usd_per_hour).cast("double")
    gpu = F.col("_s") * hour / 3600
    usd = F.coalesce("_ledger", F.col("_bill") / F.col("decisions"), gpu) * 1000
    basis = F.when(F.col("_ledger").isNotNull(), "ledger").when(F.col("_bill").isNotNull(), "bill").when(gpu.isNotNull(), "time").otherwise("unknown")
    return g.select("column", "decisions", "covered", usd.alias("usd_per_1k"), basis.alias("basis"))


def role_stats(calls: DataFrame) -> DataFrame:
    """(role, calls, failed_attempts, cost_usd, mean_latency_s, p90_latency_s) from (role, ok, cost, latency_s); latencies of successful calls."""
    x = calls.withColumn("role", F.coalesce("role", F.lit("?"))).withColumn("ok", F.coalesce("ok", F.lit(False)))
    g = x.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("failed_attempts"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost_usd"), F.round(F.avg(F.when(F.col("ok"), F.coalesce("latency_s", F.lit(0.0)))), 1).alias("mean_latency_s"))
    p = E.positional(x.where("ok").withColumn("latency_s", F.coalesce("latency_s", F.lit(0.0))), ["role"], "latency_s", {"p90_latency_s": E.P90_INNER}).select("role", "p90_latency_s")
    return g.join(p, "role", "left")


def failure_causes(gates: DataFrame) -> DataFrame:
    """(cause, n, examples): why tasks failed their gates, numbers and quotes taken out, at most three tasks as examples.

    gates: (task_id, gate, state, why); states pass and not_run are no failures, error is the infrastructure's.
    """
    said = {"oracle": "the reference answer did not pass", "noop": "an empty answer was accepted", "wrong": "a wrong answer was accepted", "alternatives": "another valid answer was rejected", "stability": "the same answer got different rewards"}
    what = F.coalesce(*[F.when(F.col("gate") == k, v) for k, v in said.items()], F.col("gate"))
    why = F.when(F.trim("why") != "", F.concat(F.lit(": "), F.col("why"))).otherwise("")
    text = F.when(F.col("state") == "error", F.concat(F.lit("infrastructure, "), F.col("gate"), why)).otherwise(F.concat(what, F.when(F.col("gate").isin("wrong", "alternatives"), why).otherwise("")))
    x = gates.where("state not in ('pass', 'not_run')").select(cause(text).alias("cause"), "task_id")
    # of the tasks of a cause the three first: the smallest of each round of a combinable minimum would not do, so ranks are cut early
    first = x.distinct().withColumn("_k", F.row_number().over(W.partitionBy("cause").orderBy("task_id"))).where("_k <= 3").groupBy("cause").agg(F.sort_array(F.collect_list("task_id")).alias("examples"))
    return x.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).join(first, "cause")


def unjustified_turns(messages: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv, idx, issue): assistant messages whose judgement is missing, negative, cites nothing, or cites what comes later.

    messages: (conv, idx, role); judged: (conv, idx, verdict, reason, relies_on array of 'system' or message numbers).
    """
    j = judged.groupBy("conv", "idx").agg(F.max(F.struct("verdict", "reason", "relies_on")).alias("j"))
    x = messages.where("role = 'assistant'").join(j, ["conv", "idx"], "left")
    late = F.filter("j.relies_on", lambda r: (r != "system") & ~F.coalesce(r.try_cast("int").between(0, F.col("idx") - 1), F.lit(False)))
    none = F.coalesce(F.size("j.relies_on"), F.lit(0)) <= 0
    issues = F.when(F.col("j").isNull(), F.array(F.lit("not judged"))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.col("j.verdict").eqNullSafe("justified"), F.concat_ws(": ", F.coalesce("j.verdict", F.lit("no verdict")), "j.reason")),
                F.when(none, "cites nothing").when(F.size(late) > 0, F.concat(F.lit("cites what is not before it: "), F.array_join(late, ", "))),
            )
        )
    )
    return x.select("conv", "idx", F.explode(issues).alias("issue"))


def carved(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(carved, unknown): rows (candidate, source_split, key, …) with the split they go to, and those no rule is for.

    rules: (candidate, source_split, split), a split or two halves as 'dev|test'. What a publisher calls train goes to
    calibration for a tenth of the keys, else to train. Halves and tenths are told by a hash of candidate and key.
    """
    b = F.conv(F.substring(F.sha2(F.concat_ws(":", "candidate", F.col("key").cast("string")), 256), 1, 2), 16, 10).cast("int") / 256
    x = rows.join(F.broadcast(rules.withColumnRenamed("split", "_rule")), ["candidate", "source_split"], "left")  # a row per publisher and split
    halves = F.split("_rule", r"\|")
    split = F.when(F.col("source_split") == "train", F.when(b < 0.1, "calibration").otherwise("train")).when(F.size(halves) > 1, F.when(b < 0.5, halves[0]).otherwise(halves[1])).otherwise(F.col("_rule"))
    x = x.withColumn("split", split).drop("_rule")
    return x.where("split is not null"), x.where("split is null").drop("split")


HELD_OUT_FIRST = ("test", "dev", "calibration", "train")


def held_out_first(rows: DataFrame, *order: str) -> DataFrame:
    """rows sorted by split, the held-out ones first, then in the given order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in HELD_OUT_FIRST]), F.col("split"))
    return rows.orderBy(F.when(rank > 0, rank).otherwise(len(HELD_OUT_FIRST) + 1), *order)


def held_out(seeds: DataFrame, key: str, share: float, path: str, seed: str = "h") -> tuple[DataFrame, DataFrame]:
    """(dev, held): a share of the keys held out, the first by hash; the list is written to path once and read ever after."""
    spark = seeds.sparkSession
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if share <= 0:
        return seeds, seeds.limit(0)
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        ids = seeds.select(key).distinct()
        n = ids.count()
        ids.orderBy(hash_order(seed, key), key).limit(max(1, round(n * share)) if n else 0).write.mode("overwrite").parquet(path)
    held = spark.read.parquet(path)
    return seeds.join(held, key, "left_anti"), seeds.join(held, key, "left_semi")


def quarantined(seeds: DataFrame, key: str, prefixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, held): seeds whose id starts with one of prefixes go to the second."""
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.coalesce(F.startswith(F.col(key).cast("string"), F.lit(p)), F.lit(False))
    return seeds.where(~bad), seeds.where(bad)


def coverage(tables: dict[str, tuple[DataFrame, Column]], most: int = 25) -> DataFrame:
    """(what, value, n, rank): what exists already, per kind the most frequent values first; null and blank count as '?'."""
    out = None
    for what, (df, value) in tables.items():
        v = F.lower(F.trim(value.cast("string")))
        x = df.groupBy(F.coalesce(F.nullif(v, F.lit("")), F.lit("?")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "value", "n")
        out = x if out is None else out.unionByName(x)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("what").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= most)


def decided(verdicts: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined): verdicts (trace_id, turn, …) on the turns (trace_id, turn, state, …) they are about; those on none, or on an ambiguous one, apart."""
    known = turns.groupBy("trace_id", "turn").agg(F.count(F.lit(1)).alias("_n"))
    x = verdicts.join(known, ["trace_id", "turn"], "left")
    rows = x.where("_n = 1").drop("_n").join(turns, ["trace_id", "turn"])
    return rows, x.where("_n is null or _n > 1").withColumn("why", F.when(F.col("_n").isNull(), "no such turn").otherwise("several such turns")).drop("_n")
