"""Scalar functions of matrix and vector entries, as Column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value) -> callable:
    return lambda x: F.lit(value)


def identity(x: Column) -> Column:
    return x


def totality(x: Column) -> Column:
    return F.lit(True)


def safe_inverse(x: Column) -> Column:
    """1 / x, and infinity for 0."""
    return F.when(x == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.when(x == 0, F.lit(1.0)).otherwise(x.cast("double")))


def second(a: Column, b: Column) -> Column:
    return b


def first(a: Column, b: Column) -> Column:
    return a


def plus(a: Column, b: Column) -> Column:
    return a + b


def minus(a: Column, b: Column) -> Column:
    return a - b


def times(a: Column, b: Column) -> Column:
    return a * b


def always(a: Column, b: Column) -> Column:
    return F.lit(True)


def exponentiate(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def random_choice(seed: int | None = None):
    """Either operand, by the toss of a coin."""
    return lambda a, b: F.when(F.rand(seed) < 0.5, a).otherwise(b)


def set_if_not_equal(value):
    """a where the operands agree, else the given value."""
    return lambda a, b: F.when(a != b, F.lit(value)).otherwise(a)


def bitwise_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bitwise_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bitwise_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def logical_xor(a: Column, b: Column) -> Column:
    return a.cast("boolean") != b.cast("boolean")


def equal(a: Column, b: Column) -> Column:
    return a == b


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def match_predicate(a: Column, b: Column) -> Column:
    """The pattern product: 1 where both are the same and not zero, else 0."""
    return F.when((a != 0) & (a == b), F.lit(1)).otherwise(F.lit(0))


def wrap8(x: Column) -> Column:
    """Arithmetic mod 256, for programs that count on 8-bit values."""
    return x.cast("long").bitwiseAND(F.lit(255)).cast("int")
