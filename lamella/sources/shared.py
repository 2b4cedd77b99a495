"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session where it is set; else (local tests) a folder below the warehouse.

    It is then also set as this context's checkpoint folder, if that has none.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lamella-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder
