"""Running sums and ranks over a total order of a whole table, without one task seeing it all.

The table is range-partitioned by the order; each range is summed on its own; the totals of the ranges
before (one row per range) are added to what a window within the range gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.session import cut


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with, for each name in sums, the sum over all rows before (excluding) this one in the order.

    order has to be total for the result to be unique. Nulls in a sum count as 0. Empty tables stay empty.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"__o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    vals = {f"__v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    x = df.withColumns(keys | vals).repartitionByRange(n, *keys).withColumn("__r", F.spark_partition_id())
    x = cut(x, "ranges")  # the range of a row is fixed once it is written
    totals = x.groupBy("__r").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    totals = totals.select("__r", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    within = W.partitionBy("__r").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    x = x.join(F.broadcast(totals), "__r")
    return x.select(*df.columns, *[(F.col(f"__b_{k}") + F.coalesce(F.sum(f"__v_{k}").over(within), F.lit(0))).alias(k) for k in sums])


def whole_groups(df: DataFrame, group: str, order: Column, most: int) -> DataFrame:
    """Rows of whole groups, in the groups' order, until the rows before a group reach most."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    kept = running(sizes, [order, group], {"_before": F.col("_n")}).where(F.col("_before") < most)
    return df.join(kept.select(group), group, "left_semi")


def ranked(df: DataFrame, by: str, order: Sequence[Column | str], place: str, size: str | None = None) -> DataFrame:
    """df with each row's 0-based place in its group, and the group's size, without one task seeing a whole group.

    Null is a group like any other. order has to be total within a group.
    """
    x = running(df, [by, *order], {"__p": F.lit(1)})
    # where a group starts follows from the sizes of the groups before it
    groups = running(df.groupBy(F.col(by).alias("__g")).agg(F.count(F.lit(1)).alias("__n")), ["__g"], {"__f": F.col("__n")})
    x = x.join(groups, F.col(by).eqNullSafe(F.col("__g")))
    return x.select(*df.columns, (F.col("__p") - F.col("__f")).alias(place), *([F.col("__n").alias(size)] if size else []))
