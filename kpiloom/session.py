"""Session settings and the folder where lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Time-zone free results, and plans that adapt to measured sizes and skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Checkpoint files go when the frame they belong to does.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, name: str = "kpiloom") -> SparkSession:
    """A session for tests and measurements on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, since no other machine has to read it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="kpiloom-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for a table that later steps read."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """The rows written to the checkpoint folder, so that nothing before is computed again.

    With `drop_shuffles`, what was shuffled for them leaves the disks as soon as they are written,
    not when the driver next collects garbage. A frame run before is not to be passed then.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not drop_shuffles:
        return df.checkpoint()
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()  # a frame has the setting of the time it is made
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
