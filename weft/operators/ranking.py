"""Global positions without a single-partition window, and checkpoints that outlive executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset a temporary folder becomes it, but only where driver and executors are one process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='weft-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def positions(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Number the rows 0, 1, ... in an order that has to be total.

    A range exchange sorts; each partition's size (one row a partition, so a small broadcast) gives
    where its numbers begin. The sorted rows are checkpointed, as both uses have to see the same ones.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = checkpointed(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", within))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    begin = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__begin"))
    return parts.join(F.broadcast(begin), "__part").withColumn(name, F.col("__begin") + F.col("__at")).drop("__part", "__at", "__begin")
