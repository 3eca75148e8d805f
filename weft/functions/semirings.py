"""Semirings: how products multiply pairs of entries and add what falls on the same place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functors import match_predicate

LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Semiring:
    """``identity`` fills dense results where nothing falls; ``single`` refuses to add at all."""

    name: str
    multiply: Callable[[Column, Column], Column]
    add: Callable[[Column], Column]
    identity: object = 0
    single: bool = False


def _saturating(a: Column, b: Column) -> Column:
    """a + b of longs, the largest long standing for infinity; sums beyond either end stop there."""
    top, low = F.lit(LONG_MAX), F.lit(-LONG_MAX - 1)
    x, y = a.cast("long"), b.cast("long")
    return F.when((x == top) | (y == top), top).otherwise(F.coalesce(F.try_add(x, y), F.when(x > 0, top).otherwise(low)))


def _only(value: Column) -> Column:
    """The one value of a group; more are an error."""
    return F.when(F.count("*") > 1, F.raise_error(F.lit("this semiring never adds two entries"))).otherwise(F.max(value))


SEMIRINGS = {
    s.name: s
    for s in (
        Semiring("plus_times", lambda a, b: a * b, F.sum, 0),
        Semiring("min_plus", _saturating, F.min, LONG_MAX),
        Semiring("select_max", lambda a, b: a * b, F.max, -1),
        Semiring("bool_max", lambda a, b: b, F.max, -1),  # a is a pattern: its value is not looked at
        Semiring("select_2nd", lambda a, b: b, F.max, 0),  # the largest, so that the choice is fixed
        Semiring("copy_2nd", lambda a, b: b, _only, 0, single=True),
        Semiring("copy_1st", lambda a, b: a, _only, 0, single=True),
        Semiring("rdf", match_predicate, F.max, 0),
        Semiring("or_and", lambda a, b: (a != 0) & (b != 0), F.bool_or, False),
    )
}


def semiring(s: str | Semiring) -> Semiring:
    if isinstance(s, Semiring):
        return s
    if s not in SEMIRINGS:
        raise ValueError(f"unknown semiring {s!r}; known are {', '.join(SEMIRINGS)}")
    return SEMIRINGS[s]
