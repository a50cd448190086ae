"""Small helpers around the Spark session the caller hands in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory used for reliable checkpoints.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``. A local session without that
    setting (tests, notebooks) gets a temporary folder; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.split("[")[0] == "local":  # not local-cluster, whose executors share no folder
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lynceus-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running ordered analyses")
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read back: cuts the lineage, keeps its columns apart and tells
    the planner its size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and pins partition numbers and row positions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
