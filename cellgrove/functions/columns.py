"""Column expressions that several operators use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """NaN as null, so that comparisons drop it."""
    return F.when(~F.isnan(c), c)


def clipped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def log_feature(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def cell(x: Column, xi: int, digits: int | None = None) -> Column:
    """Index of the half-open interval [i/xi, (i+1)/xi) that holds x; the last one is closed. Null for null and NaN.

    digits: scale, then round to so many places before flooring, so that engines that sum in another
    order agree; None: compare with the edges exactly."""
    x = number(x)
    if digits is not None:
        b = F.floor(F.round(x * F.lit(float(xi)), digits))
    else:
        b = F.floor(x * F.lit(float(xi)))
        b = F.when(x < b / F.lit(float(xi)), b - 1).when(x >= (b + 1) / F.lit(float(xi)), b + 1).otherwise(b)
    return F.when(x.isNotNull(), F.greatest(F.least(b, F.lit(xi - 1)), F.lit(0))).cast("int")


def on_edge(x: Column, xi: int, digits: int | None = None) -> Column:
    """Whether x lies on the lower edge of its interval."""
    if digits is not None:
        r = F.round(number(x) * F.lit(float(xi)), digits)
        return r == F.floor(r)
    b = F.round(number(x) * F.lit(float(xi)))
    return number(x) == b / F.lit(float(xi))


def packed(cells: list[Column], xi: int) -> Column:
    """One number for a tuple of cells; the first has the most weight."""
    return reduce(lambda a, b: a * F.lit(xi) + b, [c.cast("long") for c in cells])


def edge_text(i: int, xi: int) -> str:
    """An edge with two places, ties to even."""
    return f"{i / xi:.2f}"


def joined(c: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by)
