"""Random graphs and permutations; the same seed gives the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.matrix import SparseMatrix
from weft.operators.ranking import positions

#: The Kronecker generator's quadrant probabilities, and its edges for each vertex.
A, B, C, EDGE_FACTOR = 0.57, 0.19, 0.19, 16


#: A prime below 2 ** 31: residues, their products and their squares are longs in any engine.
PRIME = 2_147_483_647


#: Factors of the three linear functions of (edge number, bit, seed, 1) whose product mod PRIME is a draw.
LINES = ((69_621, 40_692, 48_271, 1), (1_583_458_089, 630_360_016, 742_938_285, 16_807), (950_706_376, 1_226_874_159, 62_089_911, 39_373))


def _draw(seed: int, bit: int) -> Column:
    """A number of 0 to PRIME - 1 by the edge's number and the bit, of which no part is an expression that holds another twice."""
    number = F.col("id") % PRIME
    one, two, three = ((number * a + (bit * b + seed * c + d) % PRIME) % PRIME for a, b, c, d in LINES)
    return one * two % PRIME * three % PRIME


def kronecker(spark: SparkSession, scale: int, edge_factor: int = EDGE_FACTOR, seed: int = 1, scramble: bool = True) -> DataFrame:
    """(src, dst) of a graph of 2 ** scale vertices: each bit of an edge falls in a quadrant of its own.

    Draws are functions of the edge's number and the bit, so a lost partition comes out the same again.
    """
    df = spark.range(edge_factor << scale)
    src = dst = F.lit(0).cast("long")
    edge = [int(x * PRIME) for x in (A, A + B, A + B + C)]
    for bit in range(scale):
        df, draw = df.withColumn("draw", _draw(seed, bit)), F.col("draw")
        down = draw >= edge[1]  # rows: the lower quadrants
        right = ((draw >= edge[0]) & (draw < edge[1])) | (draw >= edge[2])
        df = df.select("id", (src * 2 + down.cast("long")).alias("src"), (dst * 2 + right.cast("long")).alias("dst"))
        src, dst = F.col("src"), F.col("dst")
    if not scale:
        df = df.select("id", src.alias("src"), dst.alias("dst"))
    if scramble:
        df = df.select("id", *[_scrambled(c, scale, seed).alias(c) for c in ("src", "dst")])
    return df.select("src", "dst")


def _scrambled(column: str, scale: int, seed: int):
    """A bijection of scale-bit numbers: odd multiplications and shifts, mod 2 ** scale."""
    mask, x = (1 << scale) - 1, F.col(column)
    for k in (0x9E3779B1 + 2 * seed, 0x85EBCA6B):
        x = (x * F.lit((k | 1) & mask if scale < 31 else (k | 1) & 0x3FFFFFFF)).bitwiseAND(F.lit(mask))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, max(1, scale // 2)))
    return x


def permute_edges(edges: DataFrame, seed: int = 1) -> DataFrame:
    """The same edges in random order."""
    return edges.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst")


def vertex_names(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(id, new): a random permutation of 0, 1, ..., n - 1."""
    return positions(spark.range(n).withColumn("h", F.xxhash64(F.lit(seed), "id")), ["h", "id"], "new").select("id", "new")


def rename_vertices(edges: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Every vertex under a random new number of 0, 1, ..., n - 1."""
    names = vertex_names(edges.sparkSession, n, seed)
    out = edges.join(names.select(F.col("id").alias("src"), F.col("new").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst")
    return out.select(F.col("s").alias("src"), F.col("d").alias("dst"))


def relabelled(matrix: SparseMatrix, seed: int = 1) -> tuple[SparseMatrix, DataFrame]:
    """A square matrix under random new numbers of its vertices, and the names (id, new)."""
    if matrix.nrow != matrix.ncol:
        raise ValueError("only a square matrix has vertices to rename")
    names = vertex_names(matrix.df.sparkSession, matrix.nrow, seed)
    row, col = (names.select(F.col("id").alias(c), F.col("new").alias(f"new_{c}")) for c in ("row", "col"))
    df = matrix.df.join(row, "row").join(col, "col")
    return SparseMatrix(df.select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val"), matrix.nrow, matrix.ncol), names


def drop_deleted(edges: DataFrame) -> DataFrame:
    """Without the edges that are marked by a negative end."""
    return edges.where((F.col("src") >= 0) & (F.col("dst") >= 0))
