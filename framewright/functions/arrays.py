"""Array helpers as column expressions: work inside one row, linear in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 64


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(numbers: Column) -> Column:
    """Inclusive running sums of an INT array.

    Sums are taken in chunks, then each chunk is raised by the total of the earlier ones, since
    appending to an array copies it.
    """
    def sums(chunk: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.expr("array()").cast("array<int>").alias("a"))
        return F.aggregate(chunk, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")))["a"]

    def raised(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.expr("array()").cast("array<int>").alias("a"))
        before = F.aggregate(parts, start, lambda acc, p: F.struct((acc["s"] + F.element_at(p, -1)).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]
        return bind(before, lambda b: F.flatten(F.transform(parts, lambda p, k: bind(F.get(b, k), lambda up: F.transform(p, lambda x: x + up)))))

    def chunked(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int")),
                             lambda k: F.slice(a, k * _CHUNK + 1, _CHUNK))
        return bind(F.transform(chunks, sums), raised)

    return bind(numbers, lambda a: F.when(F.size(a) > 0, chunked(a)).otherwise(a))
