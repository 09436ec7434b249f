"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set: a folder of our own on a local master, elsewhere an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="askloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/askloom-{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI with its scheme, by the session's file systems."""
    place, system = _located(spark, path)
    return system.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _located(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place, system = _located(spark, path)
    system.delete(place, True)


def folder(spark: SparkSession, path: str) -> str:
    """path, made a folder if there is none."""
    place, system = _located(spark, path)
    system.mkdirs(place)
    return path


def until_exit(spark: SparkSession, path: str) -> str:
    """path, made a folder whose contents are deleted when the application ends."""
    place, system = _located(spark, folder(spark, path))
    system.deleteOnExit(place)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return until_exit(spark, shared_path(spark, name))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    The files are deleted by `discard`, or else when the application ends.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._askloom_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise has returned and that nothing reads any more."""
    for df in tables:
        place, system = _located(df.sparkSession, df._askloom_path)
        system.delete(place, True)
