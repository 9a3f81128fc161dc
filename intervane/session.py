"""Session helpers: settings read from the cluster, never imposed on it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from intervane.errors import ArgumentError


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data, named by the cluster in ``spark.checkpoint.dir``.

    Only a session of one machine may leave it unset; it then gets a folder among
    the files of the session, which Spark removes with it. On a cluster that is an error,
    since executors would not find such a folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if context.master.split("[")[0] != "local":
                raise ArgumentError("spark.checkpoint.dir must name a folder that all executors share")
            named = f"{context._jvm.org.apache.spark.SparkFiles.getRootDirectory()}/checkpoints"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: for small results that several steps read."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed with what is in it when the session ends."""
    path = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of which later steps read some columns each; removed when the session ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
