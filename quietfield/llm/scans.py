"""Prefixes over arrays as DataFrame functions, in time that grows with the array.

An aggregate that appends to an array copies it each time. Here pieces of bounded size are summed up first, then their
prefix is taken, and then each piece is walked from where it starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is named (in lambdas too)."""
    return F.transform(F.array(value), use)[0]


def _walk(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, first, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of some longs ``op`` over all before it, from ``zero``. ``op`` must be associative, with ``zero`` for none."""
    start = F.lit(zero).cast("bigint")

    def prefix(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE).cast("int")), lambda i: F.slice(v, i * PIECE + 1, F.lit(PIECE)))
        return let(cut, lambda pieces: F.flatten(F.zip_with(pieces, _walk(F.transform(pieces, lambda p: F.aggregate(p, start, op)), start, op), lambda p, at: _walk(p, at, op))))

    return let(values, lambda v: F.when(F.size(v) > 0, prefix(v)).otherwise(F.array().cast("array<bigint>")))


def sums_before(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def most_before(values: Column, zero: int = -1) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), zero)
