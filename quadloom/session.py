"""The shared folder of a cluster, tables written to it, and dense numbers without a one-task sort."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset on one machine, below one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.sparkContext.setCheckpointDir(root)
    return posixpath.join(root, f"{what}-{uuid.uuid4().hex}")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    to = shared_folder(df.sparkSession, what)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def dense_numbers(df: DataFrame, columns: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Distinct rows of `columns` with dense numbers from `start`, in ascending order.

    Values are spread by range and sorted within each part; a part's first number is the sum of the
    sizes of the parts before it, so only one small row a part meets in one task.
    """
    spread = df.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    parts = written(spread.withColumn("_part", F.spark_partition_id()), "numbers")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(*columns)
    ranked = parts.withColumn("_own", F.row_number().over(own) - 1)
    return ranked.join(bases, F.col("_part") == F.col("_p")).select(*columns, (F.col("_base") + F.col("_own") + start).cast("long").alias(name))
