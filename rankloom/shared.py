"""Tables in the folder that driver and executors share: written once, read by every later step, gone when the driver ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:8]
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may do without; a temporary folder then takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rankloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def path_and_files(spark: SparkSession, path: str):
    """A path as Hadoop has it, and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below this application's folder, which goes when the driver ends: returned DataFrames may read it until then."""
    folder = f"{shared_dir(spark)}/rankloom/{spark.sparkContext.applicationId}-{_RUN}"
    if folder not in _folders:
        target, files = path_and_files(spark, folder)
        files.mkdirs(target)
        files.deleteOnExit(target)
        _folders.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later step reads."""
    for path in paths:
        target, files = path_and_files(spark, path)
        files.delete(target, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder as Parquet and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table that several later steps read."""
    return materialize(df, name)[0]
