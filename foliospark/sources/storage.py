"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='foliospark-')}"


def workspace(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where it is unset sessions in one process get a folder of their own. On a cluster there is no folder
    that all share without being named, so that raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the workspace: its plan is cut, and its rows outlive lost executors.

    Tables stay until the folder is cleared: a later job may still read them.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{uuid.uuid4().hex}"
    # no _SUCCESS: nothing reads it, and the driver would start two processes for its permissions
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan would leave at least half of them idle: a file of one row group is one
    task however many cores there are. Rows are only dealt anew; a larger table isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores // 2 else df
