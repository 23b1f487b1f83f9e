"""Shared storage for intermediate tables, and how rows are dealt to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own is used, but only with a local master; a cluster
    without a shared folder is an error, as a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='vistaset-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/vistaset/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``written`` stored of these tables; nothing that is yet to run may read them."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows dealt to ``n`` tasks by columns; 0: to as many as the session has it."""
    return df.repartition(n, *by) if n else df.repartition(*by)
