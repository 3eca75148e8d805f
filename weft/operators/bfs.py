"""Breadth-first search by sparse products of the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import SparseMatrix
from .ranking import checkpointed
from .vector import SparseVector


def step(a: SparseMatrix, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """(idx, parent) of what the frontier reaches first, each with its least parent. Edges run from col to row."""
    reached = a.df.join(frontier.select(F.col("idx").alias("col")), "col").groupBy(F.col("row").alias("idx")).agg(F.min("col").alias("parent"))
    return reached.join(visited.select("idx"), "idx", "left_anti")


def bottom_up_step(a: SparseMatrix, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """The same from the other side: each row not yet visited looks for a frontier neighbour."""
    open_rows = a.df.join(visited.select(F.col("idx").alias("row")), "row", "left_anti")
    return open_rows.join(frontier.select(F.col("idx").alias("col")), "col", "left_semi").groupBy(F.col("row").alias("idx")).agg(F.min("col").alias("parent"))


def bfs(a: SparseMatrix, source: int, bottom_up: bool = False, max_depth: int | None = None) -> DataFrame:
    """(idx, parent, level) of every vertex that the source reaches; the source is its own parent at level 0.

    The edges are checkpointed once, as every round reads them, and the frontier each round, so that the plan
    doesn't grow and a lost executor costs one round; the loop ends with an empty frontier.
    """
    spark = a.df.sparkSession
    a = SparseMatrix(checkpointed(a.df.select("row", "col").withColumn("val", F.lit(1))), a.nrow, a.ncol)
    frontier = spark.range(source, source + 1).select(F.col("id").alias("idx"), F.col("id").alias("parent"), F.lit(0).cast("long").alias("level"))
    visited = frontier = checkpointed(frontier)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = (bottom_up_step if bottom_up else step)(a, frontier, visited)
        frontier = checkpointed(found.withColumn("level", F.lit(depth).cast("long")))
        if frontier.limit(1).count() == 0:
            break
        visited = checkpointed(visited.unionByName(frontier)) if depth % 8 == 0 else visited.unionByName(frontier)
    return visited


def validate(a: SparseMatrix, tree: DataFrame, source: int) -> dict[str, int]:
    """How often a BFS tree breaks each rule; all counts are 0 for a valid one.

    Parents are visited and one level up; tree edges are edges; no edge joins levels more than one apart;
    an edge from a visited vertex leads to a visited one; the source alone is at level 0.
    """
    up = tree.select(F.col("idx").alias("parent"), F.col("level").alias("above"))
    inner = tree.where(F.col("idx") != source)
    edge = a.df.join(tree.select(F.col("idx").alias("col"), F.col("level").alias("from")), "col").join(tree.select(F.col("idx").alias("row"), F.col("level").alias("to")), "row", "left")
    return {
        "parent": inner.join(up, "parent", "left").where(F.col("above").isNull() | (F.col("above") + 1 != F.col("level"))).count(),
        "edge": inner.join(a.df.select(F.col("row").alias("idx"), F.col("col").alias("parent")), ["idx", "parent"], "left_anti").count(),
        "level": edge.where(F.col("to") > F.col("from") + 1).count(),
        "missed": edge.where(F.col("to").isNull()).count(),
        "root": tree.where((F.col("level") == 0) != (F.col("idx") == source)).count(),
    }


def spmv_frontier(a: SparseMatrix, frontier: SparseVector) -> SparseVector:
    """One unvisited-agnostic step as a product: the largest frontier index that reaches each row."""
    return a.mxv(frontier, "bool_max", index_is_value=True)


__all__ = ["bfs", "bottom_up_step", "spmv_frontier", "step", "validate"]
