"""The folder that executors share, and checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration; the copy survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session() -> SparkSession:
    """The session there is, else one on all cores of this machine."""
    b = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = SparkSession.getActiveSession() or b.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
