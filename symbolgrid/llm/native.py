"""Expressions that the native operators share: bindings and running folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements folded at a time. Appending to an array copies it, so a fold over blocks copies each
#: element some BLOCK / 2 times and not as often as the array is long.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: int, fold: Callable[[Column, Column], Column]) -> Column:
    """array<int>: ``fold`` of every element of array<int> with all before it, which must be associative."""
    zero = F.struct(F.lit(start).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return let(fold(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))

    def over(all_: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda k: F.aggregate(F.slice(all_, k * BLOCK + 1, BLOCK), zero, step))

        def joined(done: Column) -> Column:
            ends = F.aggregate(F.transform(done, lambda b: b["at"]), zero, step)["out"]
            bases = F.concat(F.array(F.lit(start)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            return F.flatten(F.zip_with(done, bases, lambda b, base: F.transform(b["out"], lambda x: fold(base, x))))

        return let(blocks, joined)

    return F.when(F.size(values) > 0, let(values, over)).otherwise(F.expr("cast(array() as array<int>)"))


def running_sum(values: Column) -> Column:
    """Running sums of array<int>."""
    return _running(values, 0, lambda a, b: (a + b).cast("int"))


def running_max(values: Column) -> Column:
    """Running maxima of array<int> of values not below 0."""
    return _running(values, 0, lambda a, b: F.greatest(a, b))
