"""Whole numbers without a bound, as plain Column expressions.

A number is ``struct<limbs:array<bigint>, small:bigint>`` and stands for the product of
both. ``limbs`` are digits to the base of a million, the lowest first, each allowed to
exceed its base by a little until it is printed; they are NULL for a small number. It is
*settled* where it has no limbs, or 1 as ``small``. Small factors gather in ``small``, so
that long digits are touched once for some thirty doublings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemagauge.functions.variants import record

NUMBER = "struct<limbs:array<bigint>,small:bigint>"

_WIDTH = 6
_BASE = 10**_WIDTH
_SMALL = 10**9  # products of two are bigints


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``make``."""
    return F.transform(F.array(value), make)[0]


def small(value: int | Column) -> Column:
    """A settled number from a whole one below a thousand million."""
    return _number(F.lit(None), F.lit(value) if isinstance(value, int) else value)


def scaled(a: Column, factor: Column, more: Column) -> Column:
    """``a * factor + more`` for a factor of 1 or 2 and ``more`` of 0 or 1, settled."""
    value = a["small"] * factor + more
    by = a["small"] * factor
    limbs = F.when(a["limbs"].isNull(), F.array(value)).otherwise(
        F.transform(
            a["limbs"], lambda x, i: x * by + F.when(i == 0, more).otherwise(0)
        )
    )
    as_it_is = (factor == 1) & (more == 0) & (a["limbs"].isNull() | (a["small"] == 1))
    return (
        F.when(as_it_is, a)
        .when(a["limbs"].isNull() & (value < _SMALL), _number(F.lit(None), value))
        .otherwise(_number(_carried(limbs), F.lit(1)))
    )


def joined(a: Column, b: Column, multiply: Column) -> Column:
    """Product, or else sum, of two numbers of which ``b``, and for a sum ``a``, is settled."""
    plain = F.when(multiply, a["small"] * b["small"]).otherwise(a["small"] + b["small"])
    fits = b["limbs"].isNull() & (multiply | a["limbs"].isNull()) & (plain < _SMALL)
    none, one = _whole(0), F.array(_whole(1))
    factor = F.coalesce(a["limbs"], one)
    limbs = (
        F.when(multiply & b["limbs"].isNull(), F.transform(factor, lambda x: x * a["small"]))
        .when(multiply, _convolved(factor, b["limbs"]))
        .otherwise(
            F.zip_with(
                F.coalesce(a["limbs"], F.array(a["small"])),
                F.coalesce(b["limbs"], F.array(b["small"])),
                lambda x, y: F.coalesce(x, none) + F.coalesce(y, none),
            )
        )
    )
    rest = F.when(multiply & b["limbs"].isNull(), b["small"]).when(multiply, a["small"]).otherwise(1)
    return F.when(fits, _number(a["limbs"], plain)).otherwise(_number(_carried(limbs), rest))


def digits(a: Column) -> Column:
    """Decimal digits of a settled number, as text."""
    start = record(done=F.array().cast("array<string>"), over=_whole(0))

    def step(state: Column, limb: Column) -> Column:
        v = limb + state["over"]
        digits = F.lpad((v % _BASE).cast("string"), _WIDTH, "0")
        return record(done=F.array_append(state["done"], digits), over=_over(v))

    def text(state: Column) -> Column:
        top = state["over"].cast("string")
        return F.ltrim(F.concat(top, F.array_join(F.reverse(state["done"]), "")), F.lit("0"))

    return F.when(a["limbs"].isNull(), a["small"].cast("string")).otherwise(
        F.aggregate(a["limbs"], start, step, text)
    )


def log2(a: Column) -> Column:
    """Binary logarithm of a settled number as a double; NULL for 0."""
    n = F.size(a["limbs"])
    head = sum(
        (
            F.coalesce(F.get(a["limbs"], n - 1 - i), _whole(0)) * (1.0 / _BASE**i)
            for i in range(1, 4)
        ),
        start=F.get(a["limbs"], n - 1).cast("double"),
    )
    return F.when(a["limbs"].isNull(), F.log2(a["small"].cast("double"))).otherwise(
        F.log2(head) + (n - 1) * (_WIDTH * math.log2(10))
    )


def _whole(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _number(limbs: Column, value: Column) -> Column:
    return record(limbs=limbs.cast("array<bigint>"), small=value.cast("bigint"))


def _over(v: Column) -> Column:
    return F.call_function("div", v, _whole(_BASE))


def _carried(limbs: Column) -> Column:
    """Limbs of any size brought back to their base, or at most ten above it.

    Three rounds, in each of which every limb hands its excess to the next, turn what a
    bigint can hold into a million and nine millions, and that into a rest of ten.
    """

    def handed(x: Column, _: Column) -> Column:
        longer = F.concat(x, F.array(_whole(0)))
        return F.transform(
            longer,
            lambda v, i: v % _BASE + F.when(i > 0, _over(F.get(x, i - 1))).otherwise(_whole(0)),
        )

    return F.aggregate(F.array(*map(F.lit, range(3))), limbs, handed, _trimmed)


def _trimmed(limbs: Column) -> Column:
    """Without the zeros that three rounds can leave on top."""

    def zero(k: int) -> Column:
        return F.element_at(limbs, F.lit(-k)) == 0

    spare = F.when(~zero(1), 0).when(~zero(2), 1).when(~zero(3), 2).otherwise(3)
    return F.slice(limbs, F.lit(1), F.size(limbs) - spare)


def _convolved(x: Column, y: Column) -> Column:
    """Sums of products of limbs; nine million such products fit a bigint."""
    n, m = F.size(x), F.size(y)

    def at(k: Column) -> Column:
        places = F.sequence(F.greatest(k - m + 1, F.lit(0)), F.least(k, n - 1))
        return F.aggregate(places, _whole(0), lambda s, i: s + F.get(x, i) * F.get(y, k - i))

    return F.transform(F.sequence(F.lit(0), n + m - 2), at)
