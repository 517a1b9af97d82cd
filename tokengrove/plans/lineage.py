"""Cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. The cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: executors on other
    machines could not read it, and it would not outlive them.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()  # set from spark.checkpoint.dir, or by the application
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tokengrove-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a written table."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Later rounds do not replay it and lost executors cost nothing. A table, unlike a
    checkpointed plan, also tells Spark its true size: estimates carried through a loop
    of joins multiply round by round.
    """
    path = work_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Leave an empty table where one was written; nothing may read the old one any more."""
    spark.createDataFrame([], "gone boolean").write.mode("overwrite").parquet(path)
