"""Reductions by name: an aggregate and its identity. Any may be given as (aggregate, identity) instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Aggregate = Callable[[Column], Column]

REDUCTIONS: dict[str, tuple[Aggregate, object]] = {
    "sum": (F.sum, 0),
    "prod": (F.product, 1),
    "min": (F.min, None),  # None: no entry, no value
    "max": (F.max, None),
    "and": (F.bool_and, True),
    "or": (F.bool_or, False),
    "xor": (lambda c: F.count_if(c) % 2 == 1, False),
    "band": (F.bit_and, -1),
    "bor": (F.bit_or, 0),
    "bxor": (F.bit_xor, 0),
    "count": (F.count, 0),
}


def reduction(op: str | tuple[Aggregate, object]) -> tuple[Aggregate, object]:
    if isinstance(op, str):
        if op not in REDUCTIONS:
            raise ValueError(f"unknown reduction {op!r}; known are {', '.join(REDUCTIONS)}")
        return REDUCTIONS[op]
    return op
