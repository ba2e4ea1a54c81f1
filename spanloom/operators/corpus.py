"""Queries over whole corpora: filter, group, sample, select, compare runs.

Samples and selections order by a hash of (seed, key), so they are the same for every partitioning.
Rows of a null stratum or key form a stratum or key of their own. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import cause, hash_order
from spanloom.operators.prefix import ranked


def query(df: DataFrame, where: str | None = None, grep: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows for which an SQL expression holds and whose JSON form matches a regex.

    A row for which the expression is null doesn't match; unreadable() counts those.
    """
    out = df
    if grep is not None:
        out = out.where(F.to_json(F.struct(*df.columns)).rlike(grep))
    if where is not None:
        out = out.where(where)
    return out if limit is None else out.limit(limit)


def unreadable(df: DataFrame, where: str) -> DataFrame:
    """(errors): rows for which the expression has no value."""
    return df.agg(F.count(F.when(F.expr(where).isNull(), 1)).alias("errors"))


def group_count(df: DataFrame, by: Column | str) -> DataFrame:
    """(grp, n), most frequent first, then by name."""
    return df.groupBy((F.expr(by) if isinstance(by, str) else by).alias("grp")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grp")


def error_groups(df: DataFrame, text: str, key: str, examples: int = 3) -> DataFrame:
    """(cause, n, examples): errors by normalised cause, each with its first keys."""
    x = df.where(F.col(text).isNotNull()).select(cause(text).alias("cause"), F.col(key).alias("_key"))
    few = x.withColumn("_n", F.row_number().over(W.partitionBy("cause").orderBy("_key"))).where(F.col("_n") <= examples)
    few = few.groupBy("cause").agg(F.array_sort(F.collect_list("_key")).alias("examples"))  # at most examples each
    return x.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).join(few, "cause")


def delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of two long tables of counts; what one lacks counts as 0."""
    side = lambda df, b, a: df.select(key, (F.col(value) * b).alias("_b"), (F.col(value) * a).alias("_a"))
    x = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy(key).agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("before"), F.coalesce(F.sum("_a"), F.lit(0)).alias("after"))
    return x.withColumn("delta", F.col("after") - F.col("before"))


def stratified(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows taken from the strata in turn, in hash order within each. No stratum keeps more than n rows before the last step."""
    w = W.partitionBy(*strata).orderBy(hash_order(seed, key), key)
    x = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return x.orderBy("turn", *strata).limit(n)


def first_last_middle(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """The first, last and middle row of each stratum. Of one or two rows, those."""
    x = ranked(df, stratum, [order], "_at", "_all")
    return x.where((F.col("_at") == 0) | (F.col("_at") == F.col("_all") - 1) | (F.col("_at") == F.floor(F.col("_all") / 2))).drop("_all", "_at")


def top_by_hash(df: DataFrame, by: Sequence[str], key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows per group in hash order (a seeded sample per type or class)."""
    w = W.partitionBy(*by).orderBy(hash_order(seed, key), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def failures_first(df: DataFrame, failed: str, key: str, n: int, fails: int, seed: str = "s") -> DataFrame:
    """Up to fails failed rows, then passed ones up to n in all, topped up with failed ones if those run out."""
    x = top_by_hash(df.withColumn("_f", F.coalesce(F.expr(failed), F.lit(False))), ["_f"], key, n, seed)
    turn = F.when(F.col("_f") & (F.col("rank") <= fails), 0).when(~F.col("_f"), 1).otherwise(2)
    return x.withColumn("turn", turn).orderBy("turn", "rank").limit(n).drop("_f")


def balanced(df: DataFrame, cell: Sequence[str], best: Sequence[Column], n: int) -> DataFrame:
    """n rows over the cells in turn, the best of each cell first."""
    x = df.withColumn("turn", F.row_number().over(W.partitionBy(*cell).orderBy(*best))).where(F.col("turn") <= n)
    return x.orderBy("turn", *cell).limit(n)


def at_most(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def numbered_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Repeated ids told apart by #1, #2 … in order; the first keeps its name."""
    n = F.col("_n")
    return ranked(df, key, [order], "_n").withColumn("unique_id", F.when(n > 0, F.concat(F.col(key).cast("string"), F.lit("#"), n.cast("string"))).otherwise(F.col(key).cast("string"))).drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], replaced: str | None = None) -> DataFrame:
    """old with the rows of new put over those of the same key; rows of old for which replaced holds are dropped."""
    kept = old.join(new.select(*key).distinct(), list(key), "left_anti")
    if replaced:
        kept = kept.where(f"not coalesce({replaced}, false)")
    return kept.select(*new.columns).unionByName(new)


def clashes(df: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys under which different contents stand: (key, contents)."""
    return df.groupBy(*key).agg(F.countDistinct(F.struct(*content)).alias("contents")).where("contents > 1")


def outcomes(rows: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """Each row with the first of the named sets that holds its key, else 'unaccounted'."""
    out, pick = rows, None
    for name, s in sets.items():
        out = out.join(s.select(key).distinct().withColumn(f"_in_{name}", F.lit(True)), key, "left")
        pick = F.when(F.col(f"_in_{name}"), name) if pick is None else pick.when(F.col(f"_in_{name}"), name)
    return out.withColumn("outcome", pick.otherwise("unaccounted")).drop(*[f"_in_{n}" for n in sets])


def orphans(records: DataFrame, covered: DataFrame, key: Sequence[str]) -> DataFrame:
    """Records that nothing covers."""
    return records.join(covered.select(*key).distinct(), list(key), "left_anti")


def pivoted(findings: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Long findings as one map per key; of repeated names the largest value. A key has as many entries as there are names."""
    x = findings.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.max(value).alias("_v"))
    return x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(name, F.col("_v").alias(value)))).alias("findings"))


def matrix(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and by the given values of column."""
    return df.groupBy(row).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values], F.count(F.lit(1)).alias("total"))


def apportioned(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """(name, share): total split by largest remainders; ties by name. weights: one row per part, a small table."""
    x = weights.withColumn("_q", F.lit(total) * F.col(weight) / F.sum(weight).over(W.partitionBy()))
    x = x.withColumn("_b", F.floor("_q")).withColumn("_left", F.lit(total) - F.sum("_b").over(W.partitionBy()))
    n = F.row_number().over(W.orderBy(F.desc(F.col("_q") - F.col("_b")), name))
    return x.select(name, (F.col("_b") + (n <= F.col("_left")).cast("bigint")).alias("share"))


def key_differences(a: Column, b: Column) -> tuple[Column, Column]:
    """What one key list has and the other lacks, both ways."""
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


def duplicate_quarantine(rows: DataFrame, key: str, content: Sequence[str], target: str, group: str, split: str) -> DataFrame:
    """rows with status: duplicate_id, conflict, group_conflict, repeat or kept, the first that fits.

    duplicate_id: the id stands more than once. conflict: the same content with different targets.
    group_conflict: a group in more than one split. repeat: the same content and target as a smaller id.
    All four are combinable counts, joined back by key.
    """
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in content]), 256)
    x = rows.withColumn("_c", digest)
    ids = x.groupBy(key).agg(F.count(F.lit(1)).alias("_ids"))
    same = x.groupBy("_c").agg(F.countDistinct(target).alias("_targets"), F.min(key).alias("_first"))
    groups = x.groupBy(group).agg(F.countDistinct(split).alias("_splits"))
    y = x.join(ids, key).join(same, "_c").join(groups, group, "left")
    status = F.when(F.col("_ids") > 1, "duplicate_id").when(F.col("_targets") > 1, "conflict").when(F.col("_splits") > 1, "group_conflict").when(F.col(key) != F.col("_first"), "repeat").otherwise("kept")
    return y.withColumn("status", status).drop("_c", "_ids", "_targets", "_first", "_splits")
