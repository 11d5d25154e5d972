"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a temporary folder is used, and only under a
    local master: elsewhere executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    This cuts the lineage and survives the loss of executors; the files go with
    ``discard``, or with the cluster's own cleaning of the checkpoint folder. No
    ``_SUCCESS`` file is written: only this session reads the files, after the write, and
    on a local file system without native code each file costs two started processes.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # noqa: SLF001
    return out


def path_of(spark: SparkSession, path: str):
    """The file system and the path object that Spark would use for ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reaches."""
    system, where = path_of(spark, path)
    return system.exists(where)


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``staged`` frames that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            system, where = path_of(df.sparkSession, path)
            system.delete(where, True)
