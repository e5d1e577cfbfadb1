"""Session set-up and the shared folder used for checkpoints and work tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tablemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only in local mode (tests, a laptop) is a temporary folder created where the setting is missing.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablemill-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives a lost executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the application's work folder for a table written by a job."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def work_folder(spark: SparkSession) -> str:
    """Folder of all work tables of this application."""
    return f"{shared_root(spark).rstrip('/')}/tablemill-{spark.sparkContext.applicationId}"


def drop_work_tables(spark: SparkSession) -> None:
    """Remove the work tables of this application; to be called when no result read from them is needed any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table before work that is heavy on CPU; adaptive execution picks the partition sizes."""
    return df.hint("rebalance")


def materialised(df: DataFrame, name: str, spread_out: bool = False) -> DataFrame:
    """Write ``df`` as a parquet work table in the shared folder and read it back.

    Used before steps that scan the same rows several times: later scans read only the columns they
    need, and a lost executor costs a re-read instead of the whole upstream plan. ``spread_out`` is for
    tables that an iterative fit reads many times.
    """
    path = work_path(df.sparkSession, name)
    (spread(df) if spread_out else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
