"""Exactly one copy of each message that was delivered at least once.

Method: only (identifier, delivery order, file-row position) is shuffled. A combinable aggregate picks
the winner of each identifier; the winners' positions become one bitmap per file and 32,768-row
block, whose complement is the file's deletion vector. The wide payload is then read where it lies:
each task loads the vector of its own file from the shared folder and filters, so no payload byte is
ever shuffled and a hot identifier costs no more than any other.

Identifiers are compared in plain form: surrounding blanks, hyphens, braces and a 0x prefix are
dropped and letters lowered. Rows whose identifier is null or blank after that can't be told to be
copies of anything: they are all kept and never counted as redelivered. Of equal delivery times the
smaller delivery_id wins, of equal ids the smaller file hash and row. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import run_dir

BLOCK = 32768  # bits of one bitmap_construct_agg bitmap


def plain_id(col: Column | str) -> Column:
    """Identifier in plain form; null if nothing is left of it."""
    c = F.lower(F.translate(F.trim(F.col(col) if isinstance(col, str) else col), "-{} \t\r\n", ""))
    c = F.when(c.startswith("0x"), F.substring(c, 3, 1 << 30)).otherwise(c)
    return F.nullif(c, F.lit(""))


def positions(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The narrow scan: plain identifiers, delivery order, file hash and row number."""
    src = spark.read.parquet(path)
    return src.select(
        *[plain_id(k).alias(k) for k in keys],
        F.unix_micros(F.col(order[0]).cast("timestamp")).alias("_at"),
        F.col(order[1]).cast("bigint").alias("_no"),
        F.xxhash64(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )


def winners(pos: DataFrame, keys: list[str]) -> DataFrame:
    """One row per identifier: copies and the position of the first delivery.

    The order is one DECIMAL(38) so that every buffer of the aggregate is of fixed width: the plan
    is two HashAggregates around one exchange, with map-side combining, and never a sort.
    """
    late = F.lit(9_223_372_036_854_775_807)
    order = (F.coalesce("_at", late).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.coalesce("_no", late).cast("decimal(38,0)") % F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")
    named = pos.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_order", order)
    return named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by("_file", "_order").alias("_file"),
        F.min_by("_row", "_order").alias("_row"),
    )


def redelivered(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Identifiers that came more than once, with the number of copies."""
    return winners(positions(spark, path, keys, order), keys).where("copies > 1")


def write_vectors(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> str:
    """Write the survivors' bitmaps, sorted by file, to the shared folder; returns the path."""
    pos = positions(spark, path, keys, order)
    best = winners(pos, keys).select("_file", "_row")
    unnamed = pos.where(" or ".join(f"{k} is null" for k in keys)).select("_file", "_row")
    bits = (
        best.unionByName(unnamed)
        .groupBy("_file", F.expr(f"_row div {BLOCK}").alias("block"))
        .agg(F.expr(f"bitmap_construct_agg(_row % {BLOCK})").alias("bits"))
    )
    out = f"{run_dir(spark)}/vectors-{uuid.uuid4().hex}"
    bits.repartitionByRange("_file").sortWithinPartitions("_file", "block").write.parquet(out)
    return out


@lru_cache(maxsize=64)
def _vector(where: str, file: int) -> dict[int, np.ndarray]:
    """The bitmaps of one file by block, read once per worker from the shared folder."""
    import pyarrow.dataset as ds

    t = ds.dataset(where, format="parquet").to_table(columns=["block", "bits"], filter=ds.field("_file") == file)
    return {b.as_py(): np.unpackbits(np.frombuffer(x.as_py(), np.uint8), bitorder="little") for b, x in zip(t["block"], t["bits"])}


def _survives(where: str):
    @F.pandas_udf("boolean")
    def keep(file: pd.Series, row: pd.Series) -> pd.Series:
        out = np.zeros(len(row), bool)
        f, r = file.to_numpy(np.int64), row.to_numpy(np.int64)
        for x in np.unique(f):
            at = np.flatnonzero(f == x)
            for b in np.unique(r[at] // BLOCK):
                here = at[r[at] // BLOCK == b]
                bits = _vector(where, int(x)).get(int(b))
                if bits is not None:
                    out[here] = bits[r[here] % BLOCK] == 1
        return pd.Series(out)

    return keep


def read_once(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table at path with exactly one row per identifier; all columns as they were written."""
    src = spark.read.parquet(path)
    keep = _survives(write_vectors(spark, path, keys, order))
    return src.where(keep(F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")))
