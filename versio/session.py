"""Session helpers: a local session for tests/bench, and durable materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "versio") -> SparkSession:
    """A local[N] session with AQE on and the UI off (tests and bench only)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # pages can be long: 1000 rows per Arrow batch bounds Python worker memory
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.driver.memory", os.environ.get("VERSIO_DRIVER_MEMORY", "8g"))
        # a retried dispatch task must not race its own duplicate
        .config("spark.speculation", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    Uses ``spark.checkpoint.dir`` (the shared folder a cluster names) when set.
    Only a local-mode session with nothing configured gets a fresh temporary
    folder; on a cluster a missing setting is an error, never a local path. A
    ``file:`` folder is accepted there, as a mounted share may be one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="versio-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running versio jobs")
    return sc.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again: the lineage ends there, and columns
    that a later step does not need are not read."""
    spark, schema = df.sparkSession, df.schema
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint so later consumers never recompute
    (and never re-send requests). Survives executor loss, unlike local checkpoints."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
