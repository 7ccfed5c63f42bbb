"""Binary search in sorted arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_up_to(values: Column, limit: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    """How many leading entries of a sorted array have of(entry) <= limit. Arrays may hold up to 2^20 - 1 entries.

    Steps are tried from the largest power of two down; short arrays take six of them.
    """
    def search(bits: int) -> Column:
        steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(of(F.get(values, at + step - 1)) <= limit, at + step).otherwise(at))
    return F.when(F.size(values) < 64, search(6)).otherwise(search(20))
