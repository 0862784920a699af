"""Tables that cut a lineage: written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within spark.checkpoint.dir, as the cluster names it. A local one takes its place only where it
    is unset and the driver runs all tasks itself, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/charloom-{spark.sparkContext.applicationId}"


_kept: set[str] = set()


def _until_exit(spark: SparkSession) -> None:
    """Has what this application leaves in the shared folder deleted when its driver ends."""
    folder = shared_dir(spark)
    if folder not in _kept:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _kept.add(folder)


def release(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; for between steps whose results are written elsewhere."""
    delete(spark, shared_dir(spark))


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    _until_exit(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


#: Rows up to which a table is broadcast.
FEW = 300_000


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    if getattr(df, "_saved_at", None):
        delete(df.sparkSession, df._saved_at)
