"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Only where none is set and the session runs
    in one machine a temporary folder is made; on a cluster that is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        if not held and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set")
        context.setCheckpointDir(held or "file://" + tempfile.mkdtemp(prefix="skein-"))
        now = context._jsc.sc().getCheckpointDir()
    return (held or now.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, for results that are read more than once or that
    a long plan goes on from."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
