"""Sparse and dense vectors: (idx, val) frames with a length. All operations are lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.reductions import reduction

from .ranking import positions

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]

#: Join kinds by (nulls of the left allowed, nulls of the right allowed).
JOINS = {(False, False): "inner", (False, True): "left", (True, False): "right", (True, True): "full_outer"}


class _Vector:
    def __init__(self, df: DataFrame, length: int):
        self.df, self.length = df.select(F.col("idx").cast("long").alias("idx"), "val"), length

    def _new(self, df: DataFrame):
        return type(self)(df, self.length)

    def _pair(self, other: _Vector, how: str = "inner") -> DataFrame:
        """(idx, a, b) of this and another vector."""
        return self.df.withColumnRenamed("val", "a").join(other.df.withColumnRenamed("val", "b"), "idx", how)

    def _same_length(self, other: _Vector) -> None:
        if self.length != other.length:
            raise ValueError(f"lengths differ: {self.length} and {other.length}")

    def apply(self, f: Unary, mask: _Vector | None = None):
        """f of each value, or of those whose index the mask has."""
        if mask is None:
            return self._new(self.df.withColumn("val", f(F.col("val"))))
        inside = self.df.join(mask.df.select("idx", F.lit(True).alias("m")), "idx", "left")
        return self._new(inside.select("idx", F.when(F.col("m"), f(F.col("val"))).otherwise(F.col("val")).alias("val")))

    def apply_indexed(self, f: Binary):
        """f of each value and its index."""
        return self._new(self.df.withColumn("val", f(F.col("val"), F.col("idx"))))

    def set_to_index(self):
        return self.apply_indexed(lambda v, i: i)

    def find(self, pred) -> SparseVector:
        """The entries that satisfy a predicate, or have a value."""
        test = pred if callable(pred) else lambda v: v == pred
        return SparseVector(self.df.where(test(F.col("val"))), self.length)

    def find_indices(self, pred: Unary) -> DenseVector:
        """The indices of entries that satisfy a predicate, packed into 0, 1, ..."""
        hit = positions(self.df.where(pred(F.col("val"))), ["idx"])
        return DenseVector(hit.select(F.col("pos").alias("idx"), F.col("idx").alias("val")), self.length)

    def find_values(self, pred: Unary) -> DenseVector:
        """The values of those entries, packed into 0, 1, ..."""
        hit = positions(self.df.where(pred(F.col("val"))), ["idx"])
        return DenseVector(hit.select(F.col("pos").alias("idx"), "val"), self.length)

    def reduce(self, op, pre: Unary = lambda x: x, default=None) -> DataFrame:
        """One row (val): the reduction of all values, its identity of none, or the default where it has no identity."""
        agg, neutral = reduction(op)
        fill = default if neutral is None else neutral
        out = agg(pre(F.col("val")))
        return self.df.agg((out if fill is None else F.coalesce(out, F.lit(fill))).alias("val"))

    def count(self, pred: Unary) -> DataFrame:
        """One row (n): how many values satisfy a predicate."""
        return self.df.agg(F.count_if(pred(F.col("val"))).alias("n"))

    def min_element(self) -> DataFrame:
        """One row (idx, val): the least value at its least index."""
        least = self.df.agg(F.min(F.struct("val", "idx")).alias("m"))
        return least.select("m.idx", "m.val")

    def unique(self) -> SparseVector:
        """Each distinct value once, at its least index."""
        return SparseVector(self.df.groupBy("val").agg(F.min("idx").alias("idx")), self.length)

    def sort(self) -> DataFrame:
        """(pos, val, idx): the values in rising order and where each came from, ties by index."""
        return positions(self.df, ["val", "idx"]).select("pos", "val", "idx")

    def get(self, index: int) -> DataFrame:
        return self.df.where(F.col("idx") == index)

    def equals(self, other: _Vector) -> bool:
        if self.length != other.length:
            return False
        both = self._pair(other, "full_outer")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).limit(1).count() == 0

    def nnz(self) -> int:
        return self.df.count()

    def nnz_until(self, index: int) -> int:
        """Entries before an index."""
        return self.df.where(F.col("idx") < index).count()


class DenseVector(_Vector):
    """A vector that has every index of 0, 1, ..., length - 1 (or the first of them, where a length isn't known)."""

    @staticmethod
    def iota(spark, length: int, begin: int = 0) -> DenseVector:
        return DenseVector(spark.range(length).select(F.col("id").alias("idx"), (F.col("id") + begin).alias("val")), length)

    @staticmethod
    def full(spark, length: int, value) -> DenseVector:
        return DenseVector(spark.range(length).select(F.col("id").alias("idx"), F.lit(value).alias("val")), length)

    @staticmethod
    def concatenate(vectors: list[DenseVector]) -> DenseVector:
        """One after the other."""
        out, base = None, 0
        for v in vectors:
            part = v.df.withColumn("idx", F.col("idx") + base)
            out, base = part if out is None else out.unionByName(part), base + v.length
        return DenseVector(out, base)

    def to_sparse(self, keep: Unary = lambda v: F.lit(True)) -> SparseVector:
        return SparseVector(self.df.where(keep(F.col("val"))), self.length)

    def set(self, index: int, value) -> DenseVector:
        if not 0 <= index < self.length:
            raise IndexError(index)
        return self._new(self.df.withColumn("val", F.when(F.col("idx") == index, F.lit(value)).otherwise(F.col("val"))))

    def combine(self, other: _Vector, op: Binary, do_op: Binary | None = None, apply_nulls: bool = False, null=0) -> DenseVector:
        """op with another vector where it has an entry (or everywhere, with ``null`` for missing ones) and do_op holds; the rest stays."""
        self._same_length(other)
        both = self._pair(other, "left").withColumn("here", F.lit(True) if apply_nulls else F.col("b").isNotNull()).withColumn("b", F.coalesce("b", F.lit(null)))
        use = F.col("here") & (do_op(F.col("a"), F.col("b")) if do_op else F.lit(True))
        return self._new(both.select("idx", F.when(use, op(F.col("a"), F.col("b"))).otherwise(F.col("a")).alias("val")))

    def __add__(self, other: _Vector) -> DenseVector:
        return self.combine(other, lambda a, b: a + b)

    def __sub__(self, other: _Vector) -> DenseVector:
        return self.combine(other, lambda a, b: a - b)

    def put(self, other: SparseVector) -> DenseVector:
        """Overwrite by another vector's entries."""
        return self.combine(other, lambda a, b: b)

    def scatter(self, other: SparseVector, index: Binary, value: Binary) -> DenseVector:
        """self[index(val, idx)] = value(val, idx) for each entry; targets outside are left out, the largest of several stays."""
        to = other.df.select(index(F.col("val"), F.col("idx")).cast("long").alias("to"), value(F.col("val"), F.col("idx")).alias("v"))
        new = to.where((F.col("to") >= 0) & (F.col("to") < self.length)).groupBy(F.col("to").alias("idx")).agg(F.max("v").alias("val"))
        return self.put(SparseVector(new, self.length))

    def gather(self, other: SparseVector, index: Binary, null) -> SparseVector:
        """At each of other's indices, self[index(val, idx)], or ``null`` where there is none."""
        want = other.df.select(F.col("idx").alias("at"), index(F.col("val"), F.col("idx")).cast("long").alias("idx"))
        return SparseVector(want.join(self.df, "idx", "left").select(F.col("at").alias("idx"), F.coalesce("val", F.lit(null)).alias("val")), other.length)

    def __getitem__(self, chosen: DenseVector) -> DenseVector:
        """The values at the chosen vector's values."""
        want = chosen.df.select(F.col("idx").alias("at"), F.col("val").cast("long").alias("idx"))
        return DenseVector(want.join(self.df, "idx").select(F.col("at").alias("idx"), "val"), chosen.length)

    def sample_candidates(self, n: int, seed: int = 0) -> DenseVector:
        """n indices at random, repeats allowed."""
        spark = self.df.sparkSession
        return DenseVector(spark.range(n).select(F.col("id").alias("idx"), F.floor(F.rand(seed) * self.length).alias("val")), n)

    def random_permutation(self, seed: int = 0) -> DenseVector:
        """The same values in random order, the same for the same seed."""
        order = positions(self.df.withColumn("r", F.xxhash64(F.lit(seed), "idx")), ["r", "idx"])
        return DenseVector(order.select(F.col("pos").alias("idx"), "val"), self.length)


class SparseVector(_Vector):
    """A vector with only some entries."""

    @staticmethod
    def build(df: DataFrame, length: int, duplicates: str = "sum") -> SparseVector:
        """From (idx, val) rows; several at an index are summed, or ``first``: the least stays. An index out of range is an error."""
        agg = {"sum": F.sum, "first": F.min, "max": F.max}[duplicates]
        bad = (F.col("idx") < 0) | (F.col("idx") >= length)
        checked = df.select(F.when(bad, F.raise_error(F.concat(F.lit("index out of range: "), F.col("idx").cast("string")))).otherwise(F.col("idx")).cast("long").alias("idx"), "val")
        return SparseVector(checked.groupBy("idx").agg(agg("val").alias("val")), length)

    def to_dense(self, default=0) -> DenseVector:
        every = self.df.sparkSession.range(self.length).withColumnRenamed("id", "idx")
        return DenseVector(every.join(self.df, "idx", "left").select("idx", F.coalesce("val", F.lit(default)).alias("val")), self.length)

    def set(self, index: int, value) -> SparseVector:
        new = self.df.sparkSession.range(index, index + 1).select(F.col("id").alias("idx"), F.lit(value).alias("val"))
        return self._new(self.df.where(F.col("idx") != index).unionByName(new))

    def delete(self, index: int) -> SparseVector:
        return self._new(self.df.where(F.col("idx") != index))

    def reset(self) -> SparseVector:
        return self._new(self.df.where(F.lit(False)))

    def nziota(self, begin: int = 0) -> SparseVector:
        """The entries numbered from ``begin``."""
        return self._new(positions(self.df, ["idx"]).select("idx", (F.col("pos") + begin).alias("val")))

    def select(self, dense: DenseVector, pred: Unary) -> SparseVector:
        """The entries whose counterpart satisfies a predicate."""
        return self._new(self.df.join(dense.df.where(pred(F.col("val"))), "idx", "left_semi"))

    def select_apply(self, dense: DenseVector, pred: Unary, op: Binary) -> SparseVector:
        """The same, combined with the counterpart."""
        both = self._pair(dense).where(pred(F.col("b")))
        return self._new(both.select("idx", op(F.col("a"), F.col("b")).alias("val")))

    def drop_listed(self, selector: SparseVector, key: Unary, by_index: bool) -> SparseVector:
        """Leave out the entries whose key(val) occurs among the selector's indices or values."""
        listed = selector.df.select(F.col("idx" if by_index else "val").alias("k"))
        return self._new(self.df.withColumn("k", key(F.col("val"))).join(listed, "k", "left_anti").select("idx", "val"))

    def setminus(self, other: _Vector) -> SparseVector:
        return self._new(self.df.join(other.df, "idx", "left_anti"))

    def _union(self, other: SparseVector, sign: int) -> SparseVector:
        self._same_length(other)
        zero = lambda c: F.coalesce(c, F.lit(0))
        return self._new(self._pair(other, "full_outer").select("idx", (zero("a") + sign * zero("b")).alias("val")))

    def __add__(self, other: SparseVector) -> SparseVector:
        return self._union(other, 1)

    def __sub__(self, other: SparseVector) -> SparseVector:
        return self._union(other, -1)

    def ewise_mult(self, dense: DenseVector, exclude: bool = False) -> SparseVector:
        """The product where dense isn't zero, or with ``exclude`` the entries where it is."""
        both = self._pair(dense).where(F.col("b") == 0 if exclude else F.col("b") != 0)
        return self._new(both.select("idx", F.col("a") if exclude else F.col("a") * F.col("b")).toDF("idx", "val"))

    def ewise_apply(self, other: _Vector, op: Binary, do_op: Binary | None = None, nulls: bool = False, other_nulls: bool = False, null=0, other_null=0, intersect: bool = True) -> SparseVector:
        """op of the two at each index, for missing ones too as allowed, and not for common ones unless ``intersect``; where do_op holds.

        ``nulls``: this vector's entry may be missing, ``other_nulls``: the other's.
        """
        both = self._pair(other, JOINS[nulls, other_nulls])
        if not intersect:
            both = both.where(F.col("a").isNull() | F.col("b").isNull())
        both = both.select("idx", F.coalesce("a", F.lit(null)).alias("a"), F.coalesce("b", F.lit(other_null)).alias("b"))
        if do_op:
            both = both.where(do_op(F.col("a"), F.col("b")))
        return self._new(both.select("idx", op(F.col("a"), F.col("b")).alias("val")))

    def invert(self, length: int, duplicates=F.min, index: Binary | None = None, value: Binary | None = None) -> SparseVector:
        """Indices and values swapped; of several with a value the least index stays, or what ``duplicates`` makes of them."""
        index, value = index or (lambda v, i: v), value or (lambda v, i: i)
        out = self.df.select(index(F.col("val"), F.col("idx")).cast("long").alias("idx"), value(F.col("val"), F.col("idx")).alias("val"))
        bad = (F.col("idx") < 0) | (F.col("idx") >= length)
        out = out.withColumn("idx", F.when(bad, F.raise_error(F.lit("a value lies beyond the new length"))).otherwise(F.col("idx")))
        return SparseVector(out.groupBy("idx").agg(duplicates("val").alias("val")), length)

    def __getitem__(self, chosen: DenseVector) -> DenseVector:
        """The values at the chosen vector's values, 0 where there is none."""
        want = chosen.df.select(F.col("idx").alias("at"), F.col("val").cast("long").alias("idx"))
        return DenseVector(want.join(self.df, "idx", "left").select(F.col("at").alias("idx"), F.coalesce("val", F.lit(0)).alias("val")), chosen.length)
