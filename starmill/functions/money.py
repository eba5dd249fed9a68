"""Column helpers shared by the query suites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 22


def net_price() -> Column:
    """Line price after discount, in ten-thousandths."""
    return F.col("l_price_cents") * (100 - F.col("l_discount_percent"))


def exact_sum(units: Column | str, digits: int) -> Column:
    """Sum of whole numbers in units of 10^-digits, as an exact decimal.

    A row's number fits 64 bits; the sum over a large table need not. So the high and the
    low bits are summed apart as 64-bit integers and put together once per group: exact
    for 2^41 rows of numbers below 2^44, and an error, not a wrong sum, beyond.
    """
    units = (F.col(units) if isinstance(units, str) else units).cast("bigint")
    unit = F.lit("0." + "0" * (digits - 1) + "1").cast(f"decimal({digits + 1},{digits})")
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    whole = high * F.lit(1 << _LOW_BITS).cast("decimal(7,0)") + low
    return whole.cast("decimal(30,0)") * unit


def net_sum() -> Column:
    return exact_sum(net_price(), 4)


def rounded(total: Column, digits: int = 2) -> Column:
    """Exact decimal total, as a double for output only."""
    return F.round(total.cast("double"), digits)


def exact_mean(units: str, digits: int) -> Column:
    return F.round(exact_sum(units, digits).cast("double") / F.count(units), 4)


def mean(column: str | Column, digits: int | None = 4) -> Column:
    """Average from the exact sum, so that it does not depend on the row order."""
    value = F.col(column) if isinstance(column, str) else column
    average = F.sum(value).cast("double") / F.count(value)
    return average if digits is None else F.round(average, digits)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part.cast("double") / whole.cast("double"), digits)
