"""Running values and searches in arrays as column expressions, in time that grows with their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded one by one; a fold copies what it has at each step, so longer arrays are folded in blocks.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``first``, and it with each value taken in turn: one element more than there are values."""
    return F.aggregate(values, F.array(first), lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x))))


def running(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``op`` (associative) makes of ``first`` and all elements before it."""

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        totals = F.transform(blocks, lambda b: let(part(b), lambda p: F.aggregate(F.slice(p, F.lit(2), F.lit(BLOCK)), F.get(p, F.lit(0)), op)))
        within = lambda begins: F.flatten(F.transform(blocks, lambda b: let(part(b), lambda p: F.slice(_folded(p, F.get(begins, b), op), F.lit(1), F.size(p)))))
        return F.when(F.size(v) > 0, let(_folded(totals, first, op), within)).otherwise(F.slice(F.array(first), F.lit(1), F.lit(0)))

    return let(values, whole)


def below(ordered: Column, x: Column) -> Column:
    """How many elements of an ascending array are less than ``x``, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + F.lit(1.0))).cast("int"))
    ends = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        less, more = F.struct((middle + 1).alias("low"), at["high"].alias("high")), F.struct(at["low"].alias("low"), middle.alias("high"))
        return F.when(at["low"] >= at["high"], at).when(F.get(ordered, middle) < x, less).otherwise(more)

    return F.aggregate(steps, ends, step, lambda at: at["low"])
