"""Sparse matrices: (row, col, val) frames, unique by (row, col), with dimensions. All operations are lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.reductions import reduction
from weft.functions.semirings import Semiring, semiring

from . import tiles as tl
from .ranking import checkpointed
from .vector import JOINS, DenseVector, SparseVector

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]

#: What becomes of several entries at one place.
DUPLICATES = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


class SparseMatrix:
    """Stored zeros are entries until prune() drops them.

    What was made by tiles keeps them, packed, as products by tiles take them up; its entries are read from them.
    """

    tiles: DataFrame | None = None
    tile = 512

    def __init__(self, df: DataFrame, nrow: int, ncol: int):
        self.df, self.nrow, self.ncol = df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "val"), nrow, ncol

    def _new(self, df: DataFrame, nrow: int | None = None, ncol: int | None = None) -> SparseMatrix:
        return SparseMatrix(df, self.nrow if nrow is None else nrow, self.ncol if ncol is None else ncol)

    # -- building ---------------------------------------------------------------------------------
    @staticmethod
    def build(entries: DataFrame, nrow: int, ncol: int, duplicates: str = "max") -> SparseMatrix:
        """From (row, col, val) rows that may repeat a place."""
        return SparseMatrix(entries.groupBy("row", "col").agg(DUPLICATES[duplicates]("val").alias("val")), nrow, ncol)

    @staticmethod
    def from_tiles(tiles: DataFrame, nrow: int, ncol: int, tile: int) -> SparseMatrix:
        out = SparseMatrix(tl.entries(tiles, tile), nrow, ncol)
        out.tiles, out.tile = tiles, tile
        return out

    @staticmethod
    def from_vectors(rows: DenseVector, cols: DenseVector, values: DenseVector | object, nrow: int, ncol: int, duplicates: str = "sum") -> SparseMatrix:
        """Entry k lies at (rows[k], cols[k]); the values are a vector or one scalar."""
        df = rows.df.withColumnRenamed("val", "row").join(cols.df.withColumnRenamed("val", "col"), "idx")
        df = df.join(values.df, "idx") if isinstance(values, DenseVector) else df.withColumn("val", F.lit(values))
        return SparseMatrix.build(df.select("row", "col", "val"), nrow, ncol, duplicates)

    @staticmethod
    def from_edges(edges: DataFrame, n: int, remove_loops: bool = False, count: bool = True) -> SparseMatrix:
        """From (src, dst) rows with repeats, negative ends left out; values count the repeats, or are true."""
        kept = edges.where((F.col("src") >= 0) & (F.col("dst") >= 0))
        if remove_loops:
            kept = kept.where("src <> dst")
        return SparseMatrix(kept.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg((F.count("*") if count else F.lit(True)).alias("val")), n, n)

    # -- entries ----------------------------------------------------------------------------------
    def apply(self, f: Unary) -> SparseMatrix:
        return self._new(self.df.withColumn("val", f(F.col("val"))))

    def cast(self, kind: str) -> SparseMatrix:
        return self.apply(lambda v: v.cast(kind))

    def prune(self, pred: Unary) -> SparseMatrix:
        """Drop the entries whose value satisfies a predicate."""
        return self._new(self.df.where(~pred(F.col("val"))))

    def prune_indexed(self, pred: Callable[[Column, Column, Column], Column]) -> SparseMatrix:
        """Drop by row, column and value."""
        return self._new(self.df.where(~pred(F.col("row"), F.col("col"), F.col("val"))))

    def prune_column(self, by: DenseVector | SparseVector, op: Binary) -> SparseMatrix:
        """Drop where op(value, by[column]); columns that a sparse vector doesn't have stay as they are."""
        met = self.df.join(by.df.select(F.col("idx").alias("col"), F.col("val").alias("t")), "col", "left")
        return self._new(met.where(F.col("t").isNull() | ~op(F.col("val"), F.col("t"))).select("row", "col", "val"))

    def prune_submatrix(self, rows: DenseVector, cols: DenseVector) -> SparseMatrix:
        """Drop the entries whose row and column are both listed."""
        ri = rows.df.select(F.col("val").cast("long").alias("row")).distinct().withColumn("r", F.lit(True))
        ci = cols.df.select(F.col("val").cast("long").alias("col")).distinct().withColumn("c", F.lit(True))
        met = self.df.join(ri, "row", "left").join(ci, "col", "left")
        return self._new(met.where(F.col("r").isNull() | F.col("c").isNull()).select("row", "col", "val"))

    def dim_apply(self, dim: str, by: DenseVector | SparseVector, op: Binary, missing=0) -> SparseMatrix:
        """op(value, by[row or col]) of every entry; ``missing`` stands for what a sparse vector doesn't have."""
        met = self.df.join(by.df.select(F.col("idx").alias(_dim(dim)), F.col("val").alias("t")), dim, "left")
        return self._new(met.select("row", "col", op(F.col("val"), F.coalesce("t", F.lit(missing))).alias("val")))

    def transpose(self) -> SparseMatrix:
        return self._new(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.ncol, self.nrow)

    def remove_loops(self) -> SparseMatrix:
        return self._new(self.df.where("row <> col"))

    def loops(self) -> int:
        return self.df.where("row = col").count()

    def add_loops(self, value, replace: bool = False) -> SparseMatrix:
        """Entries on the diagonal, of a scalar or a dense vector; those that are there stay, unless ``replace``."""
        if self.nrow != self.ncol:
            raise ValueError("loops need a square matrix")
        if isinstance(value, DenseVector):
            diag = value.df.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.col("val").alias("d"))
        else:
            diag = self.df.sparkSession.range(self.nrow).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(value).alias("d"))
        both = self.df.join(diag, ["row", "col"], "full_outer")
        return self._new(both.select("row", "col", (F.coalesce("d", "val") if replace else F.coalesce("val", "d")).alias("val")))

    def find(self) -> DataFrame:
        return self.df

    def element(self, row: int, col: int) -> DataFrame:
        return self.df.where((F.col("row") == row) & (F.col("col") == col))

    def ewise_scale(self, dense: DataFrame) -> SparseMatrix:
        """The product with a dense matrix's (row, col, val), entry by entry."""
        both = self.df.join(dense.withColumnRenamed("val", "d"), ["row", "col"])
        return self._new(both.select("row", "col", (F.col("val") * F.col("d")).alias("val")))

    def update_dense(self, dense: DataFrame, op: Binary) -> DataFrame:
        """The dense matrix with op(dense, entry) where this one has an entry."""
        both = dense.withColumnRenamed("val", "d").join(self.df.withColumn("here", F.lit(True)), ["row", "col"], "left")
        return both.select("row", "col", F.when(F.col("here"), op(F.col("d"), F.col("val"))).otherwise(F.col("d")).alias("val"))

    # -- reductions -------------------------------------------------------------------------------
    def reduce_sparse(self, dim: str, op, pre: Unary = lambda x: x) -> SparseVector:
        """Of each row (``dim`` = row) or column that has entries, the reduction of their values."""
        agg, _ = reduction(op)
        out = self.df.groupBy(F.col(_dim(dim)).alias("idx")).agg(agg(pre(F.col("val"))).alias("val"))
        return SparseVector(out, self.nrow if dim == "row" else self.ncol)

    def reduce(self, dim: str, op, pre: Unary = lambda x: x, identity=None) -> DenseVector:
        """Of each row (``dim`` = row) or column, the reduction of its values; the identity where it has none."""
        _, neutral = reduction(op)
        return self.reduce_sparse(dim, op, pre).to_dense(neutral if identity is None else identity)

    def masked_reduce(self, mask: SparseVector, op, pre: Unary = lambda x: x, exclude: bool = False, identity=None) -> DenseVector:
        """The reduction of columns over the rows that the mask has, or with ``exclude`` over the others."""
        rows = self.df.join(mask.df.select(F.col("idx").alias("row")), "row", "left_anti" if exclude else "left_semi")
        return self._new(rows).reduce("col", op, pre, identity)

    def nnz(self) -> int:
        return self.df.count() if self.tiles is None else self.tiles.agg(F.sum("n")).first()[0] or 0

    def nnz_by(self, dim: str) -> DenseVector:
        return self.reduce(dim, "count")

    def shape_info(self) -> DataFrame:
        """One row: nrow, ncol, nnz."""
        return self.df.agg(F.count("*").alias("nnz")).select(F.lit(self.nrow).cast("long").alias("nrow"), F.lit(self.ncol).cast("long").alias("ncol"), "nnz")

    def load_imbalance(self) -> DataFrame:
        """One row: partitions * largest partition / all entries."""
        sizes = self.df.groupBy(F.spark_partition_id().alias("p")).count()
        return sizes.agg((F.count("*") * F.max("count") / F.sum("count")).alias("imbalance"))

    def bandwidth(self) -> DataFrame:
        """One row: the largest col - row of the upper triangle; -1 without entries there."""
        return self.df.where("row <= col").agg(F.coalesce(F.max(F.col("col") - F.col("row")), F.lit(-1)).cast("long").alias("bandwidth"))

    def profile(self) -> DataFrame:
        """One row: over the columns, the sum of col - least row <= col; a column without one counts 1."""
        least = self.df.where("row <= col").groupBy("col").agg(F.min("row").alias("least"))
        every = self.df.sparkSession.range(self.ncol).withColumnRenamed("id", "col").join(least, "col", "left")
        return every.agg(F.coalesce(F.sum(F.coalesce(F.col("col") - F.col("least"), F.lit(1))), F.lit(0)).alias("profile"))

    def limits(self) -> DataFrame:
        """One row: the least and largest row and column."""
        return self.df.agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))

    # -- elementwise ------------------------------------------------------------------------------
    def _same_shape(self, other: SparseMatrix) -> None:
        if (self.nrow, self.ncol) != (other.nrow, other.ncol):
            raise ValueError(f"shapes differ: {self.nrow} x {self.ncol} and {other.nrow} x {other.ncol}")

    def _pair(self, other: SparseMatrix, how: str = "inner") -> DataFrame:
        self._same_shape(other)
        return self.df.withColumnRenamed("val", "a").join(other.df.withColumnRenamed("val", "b"), ["row", "col"], how)

    def __add__(self, other: SparseMatrix) -> SparseMatrix:
        """Union of the patterns; common entries are added."""
        return merge_all([self, other])

    def ewise_mult(self, other: SparseMatrix, exclude: bool = False) -> SparseMatrix:
        """Products of common entries, or with ``exclude`` the entries that other lacks."""
        self._same_shape(other)
        if exclude:
            return self._new(self.df.join(other.df, ["row", "col"], "left_anti"))
        return self._new(self._pair(other).select("row", "col", (F.col("a") * F.col("b")).alias("val")))

    def ewise_not(self, other: SparseMatrix, op: Binary, default) -> SparseMatrix:
        """op(a, default) of the entries that other lacks."""
        return self._new(self.df.join(other.df, ["row", "col"], "left_anti").withColumn("val", op(F.col("val"), F.lit(default))))

    def ewise_apply(self, other: SparseMatrix, op: Binary, do_op: Binary | None = None, nulls: bool = False, other_nulls: bool = False, null=0, other_null=0, intersect: bool = True) -> SparseMatrix:
        """op of the two at each place, for missing ones too as allowed, and not for common ones unless ``intersect``; where do_op holds."""
        both = self._pair(other, JOINS[nulls, other_nulls])
        if not intersect:
            both = both.where(F.col("a").isNull() | F.col("b").isNull())
        both = both.select("row", "col", F.coalesce("a", F.lit(null)).alias("a"), F.coalesce("b", F.lit(other_null)).alias("b"))
        if do_op:
            both = both.where(do_op(F.col("a"), F.col("b")))
        return self._new(both.select("row", "col", op(F.col("a"), F.col("b")).alias("val")))

    def equals(self, other: SparseMatrix, tolerance: float = 0.0) -> bool:
        """Same shape, pattern and values; with a tolerance, values that differ by less, absolutely or relatively."""
        if (self.nrow, self.ncol) != (other.nrow, other.ncol):
            return False
        gap = F.abs(F.col("a") - F.col("b"))
        close = (gap <= tolerance) | (gap <= tolerance * F.greatest(F.abs("a"), F.abs("b"))) if tolerance else F.col("a") == F.col("b")
        return self._pair(other, "full_outer").where(~F.coalesce(close, F.lit(False))).limit(1).count() == 0

    # -- products ---------------------------------------------------------------------------------
    def mxm(self, other: SparseMatrix, by: str | Semiring = "plus_times") -> SparseMatrix:
        """The product over a semiring: one join and one aggregation with partial sums."""
        if self.ncol != other.nrow:
            raise ValueError(f"{self.nrow} x {self.ncol} times {other.nrow} x {other.ncol}")
        s = semiring(by)
        a = self.df.select("row", F.col("col").alias("k"), F.col("val").alias("a"))
        b = other.df.select(F.col("row").alias("k"), "col", F.col("val").alias("b"))
        met = a.join(b, "k").select("row", "col", s.multiply(F.col("a"), F.col("b")).alias("val"))
        return SparseMatrix(met.groupBy("row", "col").agg(s.add(F.col("val")).alias("val")), self.nrow, other.ncol)

    def _counts(self, dim: str) -> DataFrame:
        """(k, n): the entries of each row or column that has any."""
        if self.tiles is not None:
            return tl.counts(self.tiles, self.tile, dim)
        return self.df.groupBy(F.col(dim).alias("k")).agg(F.count("*").alias("n"))

    def flops(self, other: SparseMatrix) -> int:
        """How many pairs of entries the product multiplies: counted by the inner index, nothing is multiplied."""
        a, b = self._counts("col").withColumnRenamed("n", "a"), other._counts("row").withColumnRenamed("n", "b")
        return a.join(b, "k").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0

    def gram(self, tile: int = 512) -> SparseMatrix:
        """The transpose times the matrix itself, of whole numbers: by tiles, unless there are over 2^20 of them, which would hold few entries each."""
        if not self._whole() or (self.ncol // tile + 1) ** 2 > 1 << 20:
            return self.transpose().mxm(self)
        return SparseMatrix.from_tiles(tl.gram_tiles(self.df, tile), self.ncol, self.ncol, tile)

    def mxm_tiled(self, other: SparseMatrix, tile: int = 512, inner: int = 1024) -> SparseMatrix:
        """The plus_times product of whole numbers by tiles of rows, inner index and columns.

        A task multiplies the pairs of tiles of one place as small dense matrices, so pairs of entries never leave it
        and a dense inner index is no hot key. Only beyond ``inner`` inner tiles a place has several tasks, whose sums
        are added up. Sums that may not fit in 53 bits are taken in integers, and one beyond a long is an error. Places
        where products meet are entries, also if they cancel out.
        """
        met = self._tile_product(other, tile, inner, tl.all_entries(tile), tl.ENTRIES)
        if self.ncol > tile * inner:
            met = met.groupBy("row", "col").agg(F.sum("val").alias("val"))
        return SparseMatrix(met, self.nrow, other.ncol)

    def _tile_product(self, other: SparseMatrix, tile: int, inner: int, emit: Callable, schema: str) -> DataFrame:
        if self.ncol != other.nrow:
            raise ValueError(f"{self.nrow} x {self.ncol} times {other.nrow} x {other.ncol}")
        packed = lambda m: m.tiles if m.tiles is not None and m.tile == tile else tl.packed_tiles(m.df, tile)
        left = packed(self)
        return tl.product(left, left if other is self else packed(other), tile, inner, emit, schema)

    def _whole(self) -> bool:
        return dict(self.df.dtypes)["val"] in ("tinyint", "smallint", "int", "bigint")

    def _once(self) -> SparseMatrix:
        """Made once, as products read their factors again for each count."""
        if self.tiles is not None:
            return SparseMatrix.from_tiles(checkpointed(self.tiles), self.nrow, self.ncol, self.tile)
        return self._new(checkpointed(self.df))

    def _factors(self, other: SparseMatrix, by: str | Semiring, dense_from: int) -> tuple[SparseMatrix, SparseMatrix, bool]:
        """Both factors, and whether to multiply them by tiles: where that is possible and the pairs to multiply, counted first, are over ``dense_from`` for each entry."""
        if by != "plus_times" or not (self._whole() and other._whole()):
            return self, other, False
        left = self._once()
        right = left if other is self else other._once()
        return left, right, left.flops(right) > dense_from * (left.nnz() + right.nnz()) / 2

    def product(self, other: SparseMatrix, by: str | Semiring = "plus_times", dense_from: int = 50) -> SparseMatrix:
        """The product by tiles where the factors are dense enough, else by a join."""
        left, right, dense = self._factors(other, by, dense_from)
        return left.mxm_tiled(right) if dense else left.mxm(right, by)

    def square(self, by: str | Semiring = "plus_times") -> SparseMatrix:
        return self.product(self, by)

    def mxm_add(self, b: SparseMatrix, c: SparseMatrix, by: str | Semiring = "plus_times") -> SparseMatrix:
        """self + b c."""
        return merge_all([self, b.mxm(c, by)], by)

    def mxv(self, x: DenseVector | SparseVector, by: str | Semiring = "plus_times", index_is_value: bool = False) -> DenseVector | SparseVector:
        """The product with a vector: dense, with the identity where nothing falls, if x is dense, else sparse.

        ``index_is_value``: an entry of x stands for its own index.
        """
        if self.ncol != x.length:
            raise ValueError(f"{self.nrow} x {self.ncol} times a vector of {x.length}")
        s = semiring(by)
        given = x.df.select(F.col("idx").alias("col"), (F.col("idx") if index_is_value else F.col("val")).alias("b"))
        met = self.df.join(given, "col").select("row", s.multiply(F.col("val"), F.col("b")).alias("v"))
        out = SparseVector(met.groupBy(F.col("row").alias("idx")).agg(s.add(F.col("v")).alias("val")), self.nrow)
        return out.to_dense(s.identity) if isinstance(x, DenseVector) else out

    def product_nnz(self, other: SparseMatrix, approximate: bool = False) -> DenseVector:
        """How many entries each column of the product will have, exactly or by a sketch of fixed size."""
        met = self.df.select("row", F.col("col").alias("k")).join(other.df.select(F.col("row").alias("k"), "col"), "k")
        count = F.approx_count_distinct("row") if approximate else F.count_distinct("row")
        return SparseVector(met.groupBy(F.col("col").alias("idx")).agg(count.alias("val")), other.ncol).to_dense(0)

    def product_nnz_by_part(self, other: SparseMatrix, parts: int, approximate: bool = True) -> DataFrame:
        """(part, nnz): the estimated entries of the product in each of ``parts`` runs of columns, to choose partitions by."""
        by_column = self.product_nnz(other, approximate).df
        return by_column.groupBy(F.floor(F.col("idx") * parts / max(1, other.ncol)).cast("long").alias("part")).agg(F.sum("val").alias("nnz"))

    # -- selection --------------------------------------------------------------------------------
    def kselect(self, k: int, columns: SparseVector | None = None, empty=None) -> DenseVector | SparseVector:
        """Each column's k-th largest value, or its least where it has fewer; of all columns or of those that a vector has."""
        if k < 1:
            raise ValueError("k starts at 1")
        df = self.df if columns is None else self.df.join(columns.df.select(F.col("idx").alias("col")), "col", "left_semi")
        ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("val"), "row")))
        out = SparseVector(ranked.where(F.col("r") <= k).groupBy(F.col("col").alias("idx")).agg(F.min("val").alias("val")), self.ncol)
        return out.to_dense(empty) if columns is None and empty is not None else out

    def prune_recover_select(self, hard: float, select: int, recover: int, recover_share: float) -> SparseMatrix:
        """Keep each column's larger entries, as Markov clustering does between its products.

        Of the entries above ``hard``: a column with fewer than ``recover`` that sum to less than
        ``recover_share`` is cut at its recover-th largest entry instead; one with more than ``select``
        at its select-th, and if what is left then has too few and too little, at its recover-th.
        """
        above = F.when(F.col("val") > hard, F.col("val"))
        sums = self.df.groupBy("col").agg(F.count(above).alias("n"), F.coalesce(F.sum(above), F.lit(0.0)).alias("s"))
        return self._cut(sums, hard, select, recover, recover_share)

    def _cut(self, sums: DataFrame, hard: float, select: int, recover: int, recover_share: float) -> SparseMatrix:
        """As prune_recover_select, with each column's count and sum above ``hard`` given; entries that can't be kept may be left out."""
        v = F.col("val")
        # only each column's largest are ranked, and cut down before they shuffle
        ranked = self.df.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("val"), "row"))).where(F.col("r") <= max(select, recover))
        tops = ranked.groupBy("col").agg(F.min(F.when(F.col("r") <= recover, v)).alias("rth"), F.min(F.when(F.col("r") <= select, v)).alias("sth"))
        stats = sums.join(tops, "col", "left")
        over = self.df.join(tops.select("col", "sth"), "col").where((v > hard) & (v >= F.col("sth")))
        stats = stats.join(over.groupBy("col").agg(F.count("*").alias("n2"), F.sum("val").alias("s2")), "col", "left")
        poor = (F.col("n") < recover) & (F.col("s") < recover_share)
        poor2 = (F.coalesce("n2", F.lit(0)) < recover) & (F.coalesce("s2", F.lit(0.0)) < recover_share)
        cut = F.when(poor, F.col("rth")).when(F.col("n") > select, F.when(poor2, F.col("rth")).otherwise(F.col("sth"))).otherwise(F.lit(hard))
        return self._new(self.df.join(stats.select("col", cut.alias("cut")), "col").where(v >= F.col("cut")).select("row", "col", "val"))

    def mcl_step(self, other: SparseMatrix, hard: float, select: int, recover: int, recover_share: float, dense_from: int = 50) -> SparseMatrix:
        """The product, pruned by column. It is made once, as pruning reads it several times.

        By tiles, a task that has made one sends on only what can be kept of each column, whatever else the column has, and how many entries are above ``hard`` and their sum.
        """
        left, right, dense = self._factors(other, "plus_times", dense_from)
        inner = 1024
        if not dense or left.ncol > left.tile * inner:  # then a task has a part of each sum only
            met = left.mxm_tiled(right) if dense else left.mxm(right)
            return met._new(checkpointed(met.df)).prune_recover_select(hard, select, recover, recover_share)
        met = left._tile_product(right, left.tile, inner, tl.column_candidates(left.tile, hard, select, recover), tl.CANDIDATES)
        met = checkpointed(met.repartition("col"))  # a checkpoint runs its last stage again: that is not to be the product
        sums = met.where("row IS NULL").groupBy("col").agg(F.sum("n").alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
        return SparseMatrix(met.where("row IS NOT NULL"), left.nrow, right.ncol)._cut(sums, hard, select, recover, recover_share)

    # -- indexing ---------------------------------------------------------------------------------
    def __getitem__(self, chosen: tuple[DenseVector, DenseVector]) -> SparseMatrix:
        """Rows and columns by vectors of indices, which may repeat or permute them."""
        ri, ci = chosen
        r = ri.df.select(F.col("val").cast("long").alias("row"), F.col("idx").alias("r"))
        c = ci.df.select(F.col("val").cast("long").alias("col"), F.col("idx").alias("c"))
        met = self.df.join(r, "row").join(c, "col")
        return SparseMatrix(met.select(F.col("r").alias("row"), F.col("c").alias("col"), "val"), ri.length, ci.length)

    def columns(self, ci: DenseVector) -> SparseMatrix:
        c = ci.df.select(F.col("val").cast("long").alias("col"), F.col("idx").alias("c"))
        return SparseMatrix(self.df.join(c, "col").select("row", F.col("c").alias("col"), "val"), self.nrow, ci.length)

    def assign(self, ri: DenseVector, ci: DenseVector, block: SparseMatrix) -> SparseMatrix:
        """The matrix with rows ri and columns ci replaced by a block of that shape."""
        if (ri.length, ci.length) != (block.nrow, block.ncol):
            raise ValueError("the block doesn't have the shape of the indices")
        r = ri.df.select(F.col("idx").alias("row"), F.col("val").cast("long").alias("r"))
        c = ci.df.select(F.col("idx").alias("col"), F.col("val").cast("long").alias("c"))
        placed = block.df.join(r, "row").join(c, "col").select(F.col("r").alias("row"), F.col("c").alias("col"), "val")
        return self._new(self.prune_submatrix(ri, ci).df.unionByName(placed))

    def split_columns(self, parts: int) -> list[SparseMatrix]:
        """Runs of columns, numbered from 0 in each."""
        edge = [self.ncol * i // parts for i in range(parts + 1)]
        cut = lambda a, b: self.df.where((F.col("col") >= a) & (F.col("col") < b)).withColumn("col", F.col("col") - a)
        return [SparseMatrix(cut(a, b), self.nrow, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    @staticmethod
    def concat_columns(parts: list[SparseMatrix]) -> SparseMatrix:
        out, base = None, 0
        for m in parts:
            part = m.df.withColumn("col", F.col("col") + base)
            out, base = part if out is None else out.unionByName(part), base + m.ncol
        return SparseMatrix(out, max(m.nrow for m in parts), base)

    def free(self) -> None:
        self.df.unpersist()


def merge_all(parts: list[SparseMatrix], by: str | Semiring = "plus_times") -> SparseMatrix:
    """Several matrices of one shape added by a semiring."""
    s, out = semiring(by), parts[0].df
    for m in parts[1:]:
        parts[0]._same_shape(m)
        out = out.unionByName(m.df)
    return SparseMatrix(out.groupBy("row", "col").agg(s.add(F.col("val")).alias("val")), parts[0].nrow, parts[0].ncol)


def dense_reduce(dense: DataFrame, dim: str, op) -> DataFrame:
    """(idx, val) of a dense matrix's rows or columns."""
    agg, _ = reduction(op)
    return dense.groupBy(F.col(_dim(dim)).alias("idx")).agg(agg(F.col("val")).alias("val"))


def _dim(dim: str) -> str:
    if dim not in ("row", "col"):
        raise ValueError(f"dim is row or col, not {dim!r}")
    return dim
