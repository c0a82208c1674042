"""Cutting a plan: a frame that is written once and read by all that build on it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master, and an error on a cluster."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="siftwell-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    return told


def new_folder(spark: SparkSession) -> str:
    """A new folder's name in the checkpoint folder, for an index or table of several parts."""
    return f"{checkpoint_folder(spark)}/siftwell-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: computed once, however often it is read, and safe from lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores. A table of few files is dealt out, a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
