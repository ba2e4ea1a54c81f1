"""Session set-up and the folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spanloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, spark-submit brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application; for sessions that weren't started with it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="spanloom-")) / "spanloom.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(name))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests, local runs) is a machine-local folder made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = "file://" + os.path.join(tempfile.gettempdir(), "spanloom-checkpoints")
    spark.sparkContext.setCheckpointDir(where)
    return where


_RUNS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, made at first use and removed when the driver's process ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/spanloom-{app}-{uuid.uuid4().hex}"
        atexit.register(_removed, spark, app)
    return _RUNS[app]


def _removed(spark: SparkSession, app: str) -> None:
    path = _RUNS.pop(app, None)
    if path is None:
        return
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone by then; a folder left over does no harm
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the run's folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete what this run's cut() and deletion vectors left. Only once no result that reads it is needed; other runs' folders stay."""
    _removed(spark, spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
