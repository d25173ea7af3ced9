"""Tables that are written once and read several times within a query."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local master (one machine) gets a temporary folder; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")
    return f"{root.rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in a new folder() and read again.

    What several branches of a plan use is then computed once, and lineage ends: lost executors cost no
    more than the files, which all executors see.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spread(spark.read.schema(df.schema).parquet(path))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, where its source has fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
