"""Session construction and the few run-time settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", cores: str | int = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own session."""
    b = (SparkSession.builder.appName(app).master(f"local[{cores}]")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.driver.memory", "8g"))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; fall back to a
    temporary folder only on a local master, where driver and tasks share a disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-ckpt-", dir=os.environ.get("TMPDIR")))


#: Partitions of spread(); each sort of a task takes a page of up to 64 MB whatever it holds, so more of them cost small inputs dearly.
SPREAD = 48


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over a number of partitions that adaptive execution keeps, as it does for every exchange of the same step.

    It merges small partitions by their compressed bytes; rows that compress well, or that are sorted and aggregated several times in one step, then outgrow a task's memory.
    """
    return df.repartition(SPREAD, *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iterative plan in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a columnar table in the shared checkpoint folder.

    For results that one plan reads several times: it is computed once, its size is
    known to the optimizer, readers prune columns, and lost executors reread it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
