"""Tables in the folder that driver and executors share: what several steps read is written once and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this process only where all of Spark runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="proofloom-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> str:
    """The path, which exists, to be removed when the session's JVM ends."""
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(whole)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder for files of this session."""
    path = new_path(spark, name)
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(whole)
    return passing(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(passing(spark, path))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over all cores: moved by key if, and only if, their files give fewer parts than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows
