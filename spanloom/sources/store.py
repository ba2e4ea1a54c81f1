"""Content-addressed tables: a corpus is stored once, under a digest of what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.scalars import digest_id

HASHES = 4  # 64-bit sums per digest; together far beyond chance


def content_id(df: DataFrame) -> str:
    """A digest of rows and columns that doesn't depend on their order or partitioning.

    Sums of hashes combine in any order, so no row is sorted or gathered; repeated rows count.
    """
    cols = sorted(df.columns)
    as_text = [F.to_json(F.struct(F.col(c).alias("v"))).alias(c) for c in cols]
    sums = [F.sum(F.xxhash64(F.lit(i), *[F.col(c) for c in cols]).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(HASHES)]
    row = df.select(*as_text).agg(F.count(F.lit(1)).cast("string").alias("n"), *sums)
    names = F.lit(",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in cols))
    return row.select(digest_id([names, *row.columns]).alias("id")).first()["id"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def put(df: DataFrame, root: str, kind: str = "corpus", parent: str | None = None) -> str:
    """Write df under root/kind/id=<digest>, unless it's there; returns the digest. Written twice, it is stored once."""
    spark = df.sparkSession
    name = content_id(df)
    path = f"{root}/{kind}/id={name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)  # a write that broke off has no _SUCCESS
        log = spark.createDataFrame([(kind, name, parent)], "kind string, id string, parent string").withColumn("created_at", F.current_timestamp())
        log.coalesce(1).write.mode("append").parquet(f"{root}/_log")
    return name


def get(spark: SparkSession, root: str, name: str, kind: str = "corpus", verify: bool = False) -> DataFrame:
    """The stored table; verify compares its digest with its name."""
    df = spark.read.parquet(f"{root}/{kind}/id={name}")
    if verify and content_id(df) != name:
        raise ValueError(f"{kind} {name} is not what was stored")
    return df


def listed(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """(kind, id, parent, created_at), newest first."""
    x = spark.read.parquet(f"{root}/_log")
    return (x.where(F.col("kind") == kind) if kind else x).orderBy(F.desc("created_at"), "id")


def resolve(records: DataFrame, pointers: DataFrame) -> DataFrame:
    """pointers (file, pos, …) with the record they point at; null if there is none."""
    return pointers.join(records.select("file", "pos", "record"), ["file", "pos"], "left")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, published by Spark's commit protocol."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
