"""Running sums over arrays, with SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are summed one after another; an array grows by copying, so a long one is summed in blocks.
BLOCK = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, amount: Callable[[Column], Column]) -> Column:
    """array<bigint> of the sums of amount over the items up to and with each."""
    none = F.expr("cast(array() as array<bigint>)")
    zero = F.struct(F.lit(0).cast("long").alias("t"), none.alias("o"))

    def step(acc: Column, x: Column) -> Column:
        return bind(acc["t"] + amount(x), lambda now: F.struct(now.alias("t"), F.concat(acc["o"], F.array(now)).alias("o")))

    def begin(acc: Column, block: Column) -> Column:
        return F.struct((acc["t"] + block["t"]).alias("t"), F.concat(acc["o"], F.array(acc["t"])).alias("o"))

    def of(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(p), F.lit(1)) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda k: F.aggregate(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), zero, step))

        def joined(bs: Column) -> Column:
            starts = F.aggregate(bs, zero, begin, lambda acc: acc["o"])
            return F.flatten(F.zip_with(bs, starts, lambda b, s: F.transform(b["o"], lambda v: v + s)))

        return bind(blocks, joined)

    return bind(items, of)
