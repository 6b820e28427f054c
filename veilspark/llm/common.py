"""Helpers shared by the operators: tables, lineage cuts in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where it is unset in local mode (tests) a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veil-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/veil-{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str) -> DataFrame:
    """Write a table into the shared folder and read it back, so that a lost executor costs no recomputation.

    A finished phase's shuffle files stay on the executors until the driver drops its last reference; the
    collection asked for here lets Spark's cleaner free them before the next phase writes its own.
    """
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null as none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def remainder(doc_id: str, modulus: int) -> Column:
    """CRC-32 of a document id's decimal digits modulo a number; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
