"""Shared folders, and cutting a plan off from its past, safely when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder the cluster names in ``spark.checkpoint.dir``.

    In local mode a temporary folder does; on a cluster without that setting executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veil-")
    return f"{folder.rstrip('/')}/veil-{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, computed once.

    Writes a reliable checkpoint to the shared folder the cluster names in
    ``spark.checkpoint.dir``.  Without that setting the rows are cached, and
    what a lost executor held is computed again.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
