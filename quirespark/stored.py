"""Tables written on the way: they cut the lineage of iterations and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, under a temporary folder in local mode, and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_quire_tables", None)
        if not base:
            base = "file://" + (own := tempfile.mkdtemp(prefix="quire-"))
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext._quire_tables = base
    return f"{base.rstrip('/')}/quire/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/{what}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
