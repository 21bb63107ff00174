"""The exact median of a whole-number column, without holding its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12  # of a number that one pass over the column settles: 2^12 counts reach the driver


def median(df: DataFrame, column: str) -> float | None:
    """``percentile(column, 0.5)`` of a bigint column; None if it has no value.

    Spark's ``percentile`` merges a count of every distinct value in one task, whose memory grows with the
    table.  Here each pass counts the values by their high bits (map-side, at most 2^``BITS`` + 1 rows) and goes on
    with the range that holds the middle one.
    """
    c = F.col(column)
    lo, hi, n = df.agg(F.min(c), F.max(c), F.count(c)).first()
    if not n:
        return None
    value, upto = _ranked(df, c, lo, hi, (n - 1) // 2)
    after = value if n // 2 < upto else df.where(c > value).agg(F.min(c)).first()[0]
    return value if after == value else 0.5 * value + 0.5 * after


def _ranked(df: DataFrame, c: Column, lo: int, hi: int, rank: int) -> tuple[int, int]:
    """The value at ``rank`` (from 0) in order, and how many values are not greater."""
    below, here = 0, rank + 1
    while True:
        shift = max(0, (hi - lo).bit_length() - BITS)
        counts = df.where(c.between(lo, hi)).groupBy(F.shiftright(c, shift).alias("b")).count().collect()
        for b, here in sorted(map(tuple, counts)):
            if rank < below + here:
                break
            below += here
        lo, hi = max(lo, b << shift), min(hi, ((b + 1) << shift) - 1)
        if lo == hi or not shift:
            return lo, below + here
