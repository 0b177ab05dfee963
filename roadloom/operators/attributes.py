"""Attributes that change with time, as arrays of one value a slice; past the end the last value holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Op = Callable[[Column, Column], Column]
#: The operations by sign; a division by 0 is null.
OPS: dict[str, Op] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "**": F.pow}


def nth(values: Column, k: Column) -> Column:
    """The value of slice k; null for an empty or null array."""
    return F.get(values, F.least(k.cast("int"), F.size(values) - 1))


def value_at(values: Column, t: Column, minutes: float) -> Column:
    return nth(values, F.floor(t / minutes))


def with_value(values: Column, t: int, minutes: int, value: Column) -> Column:
    """The array with another value in the slice of minute t; slices up to one past the end get the last value."""
    k = t // minutes
    inside = F.transform(values, lambda v, i: F.when(i == k, value).otherwise(v))
    beyond = F.concat(values, F.array_repeat(F.get(values, F.size(values) - 1), F.lit(k) - F.size(values)), F.array(value))
    return F.when(F.size(values) > k, inside).otherwise(beyond)


def combined(a: Column, b: Column, op: str) -> Column:
    """Slice by slice; the shorter array goes on with its last value. Empty where both are."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: OPS[op](nth(a, k), nth(b, k)))).otherwise(F.slice(a, 1, 0))


def scaled(a: Column, op: str, number: float) -> Column:
    return F.transform(a, lambda v: OPS[op](v, F.lit(number)))


def scaled_at(a: Column, op: str, number: float, t: int, minutes: int) -> Column:
    """Only the slice of minute t changes."""
    return F.transform(a, lambda v, i: F.when(i == t // minutes, OPS[op](v, F.lit(number))).otherwise(v))


def resized(a: Column, minutes: int, total: int, new_minutes: int, offset: int = 0) -> Column:
    """Slices of new_minutes over `total` minutes from minute `offset` on, each with the value at its start."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-total // new_minutes) - 1))), lambda k: value_at(a, k * new_minutes + offset, minutes))
