"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marketloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar operators (months, days, closed windows) are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and interim tables, which driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made for a
    ``local`` master only: on a cluster each executor would write to a disk of its own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def keyed_state(spark: SparkSession) -> None:
    """Streams with map state or timers need the RocksDB state store; queries started before keep the one in their checkpoint."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def interim(df: DataFrame) -> DataFrame:
    """Store a result that several later scans read, as a columnar table in the shared folder.

    Unlike a cache it survives lost executors; unlike a checkpoint later reads prune columns and push
    filters.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/interim/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like :func:`interim`, in files by hash of ``column``: groups and joins by it later don't shuffle this side again."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark).rstrip('/')}/interim/{name}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(f"interim_{name}")
    return spark.table(f"interim_{name}")
