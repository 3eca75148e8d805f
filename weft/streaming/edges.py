"""Edges that arrive as a stream: a table of distinct edges that patterns are run over between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_sink(edges: DataFrame, path: str, checkpoint: str, batch_partitions: int | None = None) -> StreamingQuery:
    """Append each batch's distinct (row, col, val) edges to a Parquet table partitioned by predicate and batch.

    A batch that is tried again overwrites its own folder, so every edge lands once. Readers fold edges
    that came in several batches with current_edges().
    """

    def write(batch: DataFrame, number: int) -> None:
        out = batch.select("row", "col", "val").distinct()
        (out.repartition(batch_partitions, "val") if batch_partitions else out).write.mode("overwrite").partitionBy("val").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(spark, path: str) -> DataFrame:
    """The table as of the batches written so far."""
    return spark.read.option("basePath", path).parquet(path).groupBy("row", "col", "val").agg(F.min("batch").alias("since")).select("row", "col", "val")
