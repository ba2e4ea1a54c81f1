"""Connected components of a table of links, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link the smallest node it is linked with, directly or not.

    Each round every node takes the least label among its own, its neighbours' and its label's; the
    labels of a path of length n settle in about log n rounds. Labels are written to the shared folder
    each round, so a lost executor costs one round at most. Loops and repeated links do no harm.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("_near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_jump"))
        new = labels.join(near, "node", "left").join(jump, "component", "left").select("node", F.col("component").alias("_old"), F.least("component", "_near", "_jump").alias("component"))
        new = cut(new, "labels")
        if new.where("component <> _old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
